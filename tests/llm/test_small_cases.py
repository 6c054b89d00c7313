"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallywork.llm import collision_ann, decontaminate, line_dedup, ngram_join, pii, piece_lattice, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, pos int, h long, h1 long, term long, root long, anchor long"
LONG = "A very long line of words. " * 4000


def rows(*pairs):
    return [(i, t, "en", "s", len(t or ""), 0.5, 3, 1, 2, 3, 4, 5, 6) for i, t in pairs]


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing names, nulls, empties, ties, repeated rows and a long text."""
    data = rows((1, None), (2, ""), (3, LONG), (4, "same text of some words here\nsecond line of it"), (5, "same text of some words here\nsecond line of it"), (5, "same text of some words here\nsecond line of it"), (None, "same text of some words here\nsecond line of it"), (6, "one"), (7, "\n\n \t"))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(odd, none):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    assert line_dedup.dedup_lines(odd).count() == 9 and line_dedup.dedup_lines(none).count() == 0
    assert (got[1]["n_lines"], got[2]["n_lines"], got[7]["n_lines"]) == (1, 1, 3)
    assert got[4]["n_dropped"] == 0 and got[5]["n_dropped"] == 2 and got[5]["kept_text"] == "" and got[None]["n_dropped"] == 0
    assert got[5]["keep_bitmap"] == [0, 2] and got[4]["keep_bitmap"] == [2] and got[1]["keep_bitmap"] == [1] and got[3]["kept_text"] == LONG and got[5]["score"] == 0.5


def test_line_dedup_passes_columns_of_any_name(odd):
    names = ["runs", "own_hash", "hash", "id", "lines", "own", "doc", "text_hash", "keep_bitmap", "n_lines"]
    got = line_dedup.dedup_lines(odd.select("doc_id", "text", *(F.lit(n).alias(n) for n in names)))
    assert sorted(got.columns) == sorted({"doc_id", "text", "kept_text", "n_dropped", *names})
    assert all(r[n] == n for r in got.collect() for n in names[:-2]) and got.agg(F.sum("n_lines")).first()[0] == 15


def test_line_dedup_keeps_short_keys_and_repeats_in_the_first(spark):
    df = spark.createDataFrame([(1, "short\nA long enough line\na LONG enough line \nx"), (2, "short\n\tA long ENOUGH line\nfresh line of doc two")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "short\nA long enough line\na LONG enough line \nx", 2: "short\nfresh line of doc two"}


def test_sharding(odd, none, spark):
    assert sharding.shard_documents(none).count() == 0
    got = sharding.shard_documents(odd).collect()
    counts = np.bincount([r["shard"] for r in got], minlength=16)
    assert len(got) == 9 and counts.max() - counts.min() <= 1
    assert all(r["size"] == 1 for r in got if r["doc_id"] in (1, 2)) and all(r["text_crc32"] == 0 for r in got if r["doc_id"] in (1, 2))
    # One group with a third of all rows, and many small ones.
    data = [(k, "hot" if k % 3 == 0 else f"group {k // 4}") for k in range(1200)]
    got = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    counts = np.bincount([r["shard"] for r in got], minlength=16)
    assert counts.tolist() == [75] * 16
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(75))
    texts = dict(data)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    spread: dict[str, set] = {}
    for r in got:
        spread.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    whole = [len(s) == 1 for t, s in spread.items() if t != "hot" and sum(v == t for v in texts.values()) > 1]
    assert sum(whole) >= 0.9 * len(whole) and len(spread["hot"]) >= 6


def test_collision_counting_against_all_pairs(spark):
    make = np.random.default_rng(3)
    x = make.standard_normal((3000, 24))
    x[100:1100] = x[50]  # a third are copies of one query
    x[7] = x[0] * 2
    data = [(k, v.tolist()) for k, v in enumerate(x)]
    data += [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [float("inf")] + [0.0] * 23), (9200, [1.0, 2.0]), (None, x[1].tolist()), (9250, [None] * 24)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got: dict[int, list] = {}
    for r in collision_ann.search(df, F.col("vec_id") % 50 == 0, block_rows=900, query_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hit = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        exact = unit @ unit[q]
        exact[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(exact, 12)))[:5]
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(exact[v] - s) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[150])] == [50, 100, 101, 102, 103]
    assert collision_ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = collision_ann.search(df.filter("vec_id in (0, 50, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 6


def test_pii_spans(odd, none):
    assert pii.find_pii(none).count() == 0 and pii.find_pii(odd).filter("n_email + n_ip + n_card + n_phone = 0").count() == 9
    text = "é mail a.b@c-d.example.org, 10.0.0.255 999.1.1.1, card 4337-1665 98464399 and +1 (456) 555-2186!"
    base = pii.detect(text)
    assert [text[a:b] for a, _, b in base] == ["a.b@c-d.example.org", "10.0.0.255", "4337-1665 98464399", "+1 (456) 555-2186"]
    assert pii.detect("x@y") == [] and pii.detect("1.2.3.4.5.6.7.8") == [(0, 1, 7), (8, 1, 15)]
    assert pii.detect("a@b.c@d.e") == [(0, 0, 5)] and pii.detect("4337166598464398") == []
    hidden = {
        "write to john [at] foo [dot] com": "john [at] foo [dot] com",
        "jane.doe at mail dot example dot org": "jane.doe at mail dot example dot org",
        "call plus one four five six five five five one two three four": "plus one four five six five five five one two three four",
        "from јohn@ехample.com today": "јohn@ехample.com",
        "full ４３３７１６６５９８４６４３９９ width": "４３３７１６６５９８４６４３９９",
    }
    for text, span in hidden.items():
        assert span in [text[a:b] for a, _, b in pii.detect(text) + pii.added(text, pii.detect(text))], text
    for clean in ("look at that dot over there", "one two three ways at once", "at the dot com boom"):
        assert pii.added(clean, []) == []


def test_pii_adds_whole_spans_over_parts_that_the_base_finds():
    hidden = {
        "mail jоhn.smith@example.com now": ("hn.smith@example.com", "jоhn.smith@example.com"),
        "call +1 456 555 218 six five four three today": ("+1 456 555 218", "+1 456 555 218 six five four three"),
        "call +1 456 555 2186４３ today": ("+1 456 555 2186", "+1 456 555 2186４３"),
        "mail a@b.c [dot] uk now": ("a@b.c", "a@b.c [dot] uk"),
    }
    for text, (part, whole) in hidden.items():
        base = pii.detect(text)
        assert [text[a:b] for a, _, b in base] == [part] and [text[a:b] for a, _, b in pii.added(text, base)] == [whole], text
    assert pii.added("a@b.com and c [at] d [dot] org", [(0, 0, 7)]) == [(12, 0, 30)]
    for domain in ("it", "ch", "photography", "museum", "co dot nz"):
        text = f"write to jane at mail dot {domain}"
        assert [text[a:b] for a, _, b in pii.added(text, [])] == [f"jane at mail dot {domain}"], text
    assert pii.added("look at the dot now, or at that dot in the corner at my dot over there", []) == []
    assert [s[1] for s in pii.added("look at that dot in john at foo dot com", [])] == [0]


def disguises(pick):
    """(disguised identifier, kind) made at random, one way of hiding it each."""
    name = pick.choice(["john", "a.smith", "maria_92", "x-ray", "li"]) + str(pick.randint(0, 99))
    host, tld = pick.choice(["mail", "example", "my-host", "uni7"]), pick.choice(["com", "org", "de", "museum", "ninja"])
    number = lambda n: "".join(str(pick.randint(0, 9)) for _ in range(n))
    words = "zero one two three four five six seven eight nine".split()
    spelled = lambda digits: pick.choice([" ", ", ", "-"]).join(words[int(c)] for c in digits)
    alike = {v: k for k, v in pii._LOOKALIKES.items()}
    swap = lambda t: "".join(alike.get(c, c) for c in t)
    marks = lambda t: "".join(c + "\u0301" if c.isalpha() and k % 2 else c for k, c in enumerate(t[:-1])) + t[-1]
    bold = lambda t: "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in t)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in t)
    ways = [
        (f"{name} [at] {host} [dot] {tld}", 0), (f"{name}(at){host}(dot){tld}", 0), (f"{name} at {host} dot {tld}", 0), (f"{name} at {host} dot co dot {tld}", 0),
        (f"{name} at {host}.com", 0), (f"{name} @ {host}.org", 0), (swap(f"{name}@{host}.{tld}"), 0), (bold(f"{name}@{host}.{tld}"), 0), (marks(f"{name}@{host}.{tld}"), 0),
        (wide(f"{name}@{host}.{tld}"), 0), (f"plus {spelled(number(11))}", 3), (wide("+" + number(12)), 3), (spelled("10") + " dot " + " dot ".join(words[pick.randint(0, 9)] for _ in range(3)), 1),
    ]
    return pick.choice(ways)


def test_pii_recall_offsets_and_false_spans_over_a_table_of_disguises(spark):
    pick = random.Random(11)
    filler = ["look at that dot over there", "meet me at noon", "he was at home.It rained", "three or four of us", "see you at the door dot", "plus two more", "été à la mer"]
    rows, found, false = [], 0, 0
    for k in range(600):
        hidden, kind = disguises(pick)
        before, after = pick.choice(filler) + ". ", " ; " + pick.choice(filler)
        rows.append((k, before + hidden + after, len(before), kind, len(before) + len(hidden)))
    clean = [(1000 + k, " ".join(pick.choice(filler) for _ in range(5)), 0, 0, 0) for k in range(300)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows + clean, "doc_id long, text string, a int, kind int, b int")).collect()}
    for k, _, a, kind, b in rows:
        spans = got[k]["spans"].split(",")
        found += f"{pii.KINDS[kind]}:{a}:{b}" in spans
    false = sum(got[k]["n_added"] for k, *_ in clean)
    assert found >= 0.97 * len(rows) and false == 0, (found, false)


def test_pii_takes_plain_hosts_after_a_bare_at_only_with_a_cue():
    for text, span in {"contact jane at example.com now": "jane at example.com", "j.doe at example.org": "j.doe at example.org", "jane @ example.com": "jane @ example.com"}.items():
        assert [text[a:b] for a, _, b in pii.added(text, pii.detect(text))] == [span], text
    for text in ("we arrived at example.com yesterday", "he stayed at home.It rained", "lunch @ noon.Then home", "read it at docs.python please"):
        assert pii.added(text, pii.detect(text)) == [], text


def test_pii_columns_of_a_frame_against_plain_patterns(spark):
    import re

    pick = random.Random(21)
    pieces = ["a.b@c-d.org ", "10.0.0.1 ", "1.2.3.400 ", "+1 (456) 555-2186 ", "4337-1665 98464399 ", "4337166598464398 ", "é中 ", "x ", "0000 0000 0000 0000 0000 "]
    rows = [(k, "".join(pick.choice(pieces) for _ in range(pick.randint(0, 8)))) for k in range(300)]

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0

    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r["doc_id"]][1]
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and luhn(d)]
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"] == line
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[1] == j for w in want) for j in range(4)]


def test_pii_is_linear_in_hostile_texts():
    for text in ("a" * 200_000, "1" * 200_000, " " * 200_000, "+1" + " " * 200_000, "1." * 100_000, "a@" * 50_000, "[" * 100_000 + " dot"):
        pii.added(text, pii.detect(text))


def test_pii_base_against_plain_patterns():
    import re

    pick = random.Random(9)
    for _ in range(2000):
        text = "".join(pick.choice("ab1.@+-() 2é") for _ in range(pick.randint(0, 60)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
        assert [s for s in pii.detect(text) if s[1] != 2] == sorted(want), text


def test_token_counts(odd, none, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = spark.createDataFrame([(20, "a <|endoftext|> b"), (21, "ünï 日本 🙂")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    cache = str(tmp_path / "cache")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, cache).collect()
        assert len(got) == 11
        for r in got:
            n = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 1024)
        assert spark.read.parquet(cache).count() == 6  # distinct texts that aren't empty, encoded once
    assert token_counts.count_tokens(none, path, str(tmp_path / "other")).count() == 0


def test_jaccard(odd, none):
    assert ngram_join.jaccard_components(none).count() == 0
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(odd, 3, 90).collect()}
    assert [got[k]["n_shingles"] for k in (1, 2, 7, 6)] == [0, 0, 0, 1]
    assert [got[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 7] and got[None]["component_id"] is None


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 1_500_000), (5, 80, 1_500_000), (3, 90, 400), (2, 60, 1_500_000)])
def test_jaccard_against_all_pairs(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    pick = random.Random(words)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [pick.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(25):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([1, 2, 4, 6, 12, 40, 120]))]
        if pick.random() < 0.5:
            base += passage
        for _ in range(pick.randint(1, 6)):
            own = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 5])):
                own[pick.randrange(len(own))] = pick.choice(vocabulary)
            texts.append(" ".join(own) if pick.random() < 0.7 else "\n".join(own).upper())
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)})
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(df, words, percent).collect()}
    assert got == {k: (len(sets[k]), find(k), links[k]) for k in range(len(sets))}


def test_divide_skip_against_all_pairs():
    pick = random.Random(5)
    for _ in range(150):
        sets = []
        for _ in range(pick.randint(1, 4)):
            base = [pick.randrange(400) for _ in range(pick.choice([3, 10, 30, 60]))]
            for _ in range(pick.randint(1, 8)):
                own = set(base)
                for _ in range(pick.choice([0, 1, 2, 3, 6])):
                    own ^= {pick.randrange(400) if pick.random() < 0.5 or len(own) < 2 else pick.choice(sorted(own))}
                sets.append(own | {1})
        n, percent = len(sets), pick.choice([50, 60, 80, 90])
        weights, ids = np.array([pick.randint(1, 4) for _ in range(n)]), np.array(pick.sample(range(1000), n))
        left = None if pick.random() < 0.5 else np.array([pick.random() < 0.5 for _ in range(n)])
        want = [0] * n
        for a in range(n):
            for b in range(n):
                if a != b and (left is None or left[a] != left[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    want[a] += weights[b]
        links, found = ngram_join.divide_skip(ids, [np.array(sorted(s), np.uint64) for s in sets], weights, percent, left)
        assert links.tolist() == want
        joined = {i: {i} for i in ids.tolist()}
        for a, b in found:  # no link is one too many
            assert joined[a] is not joined[b]
            joined[a] |= joined[b]
            for i in joined[b]:
                joined[i] = joined[a]
        for a in range(n):
            for b in range(n):
                if a != b and (left is None or left[a] != left[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    assert joined[int(ids[a])] is joined[int(ids[b])]


def test_decontamination(odd, none, spark):
    item = "In Paris John Smith bought 12 apples for 30 cents and then he gave 12 of them to Mary before he went home again"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(7))
    changed = "In Rome Anna bought 7 apples for 55 euros and then he gave 7 of them to Peter before he went home again"
    broken = "In Rome Anna bought 7 apples for 55 cents and then he gave 9 of them to Peter before he went home again"
    docs = spark.createDataFrame([(1, "Intro words here. " + item + " And more."), (2, changed), (3, broken), (4, "Nothing of the kind is in here at all, 12 apples or not."), (5, item), (5, item), (None, item), (6, None), (7, "")], "doc_id long, text string").withColumn("h", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 1)}
    assert got[1, 1]["n_changed"] == 0 and got[2, 1]["n_changed"] >= 5 and got[1, 1]["n_matched"] == got[1, 1]["n_windows"]
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, items).count() == 0


def test_canonical_text_has_the_words_of_the_tokens(spark, sf_dir):
    pick = random.Random(11)
    words = ["5", "12:30", "KG", "kg", "Km", "Paris", "John", "apples", "the", "HOURS", ".", "!", "?", "..", "Éa", "ǅ", "ß", "x", ",", "a1B", "1.5kg", "\n", "\u2102x", "K", "ΑΣ", "日本", "#number"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 14))) for _ in range(1500)] + ["", "5 KG Paris John ate. 3 kg Paris"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit(""))))
    both = decontaminate.with_tokens(df, F.col("text")).select("text", F.transform("tokens", lambda t: t["c"]).alias("c"), decontaminate.canonical(F.col("text")).alias("words"))
    for r in both.collect():
        assert [w for w in r["words"].split(" ") if w] == r["c"], r["text"][:200]


def test_decontamination_of_short_items(spark):
    items = spark.createDataFrame([(1, "Who is Zorbax?"), (2, "7 8 9 10 11 12"), (3, "..."), (4, "the exact words of a longer item of the benchmark")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So, who is\nzorbax, really?"), (2, "who is the Zorbax"), (3, "they said 7, 8, 9, 10, 11, 12!"), (4, "7 8 9 10 11 13"), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["n_slots"], r["n_changed"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): (1, 1, 0, 0), (3, 2): (1, 1, 6, 0)}


def test_decontamination_judges_each_place_of_an_item(spark):
    item = "In Paris John Smith bought 12 apples for 30 cents and then he gave 12 of them to Mary before he went home again"
    other = "In Rome Anna bought 7 apples for 55 euros and then he gave 7 of them to Peter before he went home again"
    third = "In Oslo Erik bought 5 apples for 20 crowns and then he gave 5 of them to Nina before he went home again"
    broken = "In Rome Anna bought 7 apples for 55 cents and then he gave 9 of them to Peter before he went home again"
    tail = " where the rest of the family had long been waiting for supper and asked how many of the apples were left in the basket"
    longer = item + tail.replace("how many", "just how many") + ". In between. " + broken + tail
    items = spark.createDataFrame([(1, item), (2, other), (3, item + tail)], "item_id long, text string")
    texts = {1: f"{item}. {other}.", 2: f"{other}. Some words between them. {third}", 3: f"{broken}. {broken}.", 4: longer, 5: f"Gave 99 of them to Zoe before he went. {item}."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 4, 5) for i in (1, 2)} | {(4, 3)}  # one more word in the tail of 4
    assert all(got[k]["n_changed"] == 0 for k in ((1, 1), (1, 2), (2, 2), (4, 1), (4, 3), (5, 1))) and got[2, 1]["n_changed"] >= 5
    assert all(r["n_matched"] <= r["n_windows"] and 100 * r["n_matched"] >= 80 * r["n_windows"] for r in got.values())


def test_toxicity(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(none, empty).count() == 0
    got = toxicity.score_toxicity(odd, empty).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    pick, words = random.Random(1), ["alpha", "beta", "gamma", "delta", "omega", "table", "chair"]
    data, labels = [], []
    for k in range(600):
        text, bad = " ".join(pick.choice(words) for _ in range(40)), k % 6 == 0
        if bad:
            text += " " + pick.choice(["idiot", "you worthless scum", "grumbolex grumbofant grumbolis", "grumbovar"])
        data.append((k, text))
        labels.append((k, 1, int(bad)))
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, known).collect()}
    fold = [k for k, _ in data if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == set(fold)
    assert np.mean([got[k]["predicted"] == (k % 6 == 0) for k in fold]) >= 0.98


def test_toxicity_scores_do_not_depend_on_the_cap_of_the_sample(spark):
    pick, words = random.Random(4), ["alpha", "beta", "gamma", "delta", "omega", "table", "chair"]
    data, labels = [], []
    for k in range(3000):
        bad = k % 12 == 0
        # Weak votes in both classes: exclamations in half of the toxic and in a tenth of the clean texts.
        text = " ".join(pick.choice(words) for _ in range(40)) + (" idiot" if pick.random() < (0.6 if bad else 0.01) else "") + ("!!!" if pick.random() < (0.5 if bad else 0.1) else "")
        data.append((k, text))
        labels.append((k, 1, int(bad)))
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, capped = ({r["doc_id"]: r for r in toxicity.score_toxicity(docs, known, sample_rows=n).collect()} for n in (4000, 250))
    for k, r in whole.items():
        assert abs(r["score"] - capped[k]["score"]) < 0.08, (data[k], r, capped[k])
    base = np.mean([y for _, _, y in labels])
    assert abs(np.mean([r["score"] for r in capped.values()]) - base) < 0.02
    assert sum(r["predicted"] != capped[k]["predicted"] for k, r in whole.items()) <= 30


def test_pieces(odd, none, spark):
    import sentencepiece
    from unigram_model import as_unigram

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert piece_lattice.encode(none, path).count() == 0
    got = {r["doc_id"]: r for r in piece_lattice.encode(odd, path).collect()}
    assert got[1]["n_pieces"] == 0 and got[2]["best_scores"] == [0.0] and all(r["round_trip"] for r in got.values())
    model = piece_lattice.load(path)
    assert got[3]["ids_sha256"] == hashlib.sha256(np.array(model.n_best(LONG, 1)[0][1], np.int32).tobytes()).hexdigest()
    model = piece_lattice.PieceModel(path, zipf=False)  # the scores of the file, as the library takes them
    library = sentencepiece.SentencePieceProcessor()
    with open(path, "rb") as f:
        library.load_from_serialized_proto(as_unigram(f.read()))
    for text in ("Hello world this is", "a", "unbelievable transmogrification", "x" * 40, "der schnelle Fuchs, gewiß", "  two  blanks "):
        want = [sum(library.get_score(i) for i in ids) for ids in library.nbest_encode_as_ids(text, 6)]
        mine = model.n_best(text, 6)
        assert [s for s, _ in mine] == pytest.approx(want)
        assert len({tuple(ids) for _, ids in mine}) == len(mine)
        for score, ids in mine:
            assert model.decode(ids) == text and sum(library.get_score(i) for i in ids) == pytest.approx(score)
    for text in ("tab\tnew\nline", "日本語の🙂", "\x00", "﷽ é"):
        assert model.decode(model.n_best(text, 2)[0][1]) == text


def test_pieces_query_against_the_library_and_enumeration(spark, sf_dir):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.load(path)
    assert abs(sum(np.exp(s) for s, _ in model.scores.values()) - 1) < 1e-9
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, agreed, pieces = piece_lattice.query(spark, sf_dir).collect(), 0, 0
    assert len(rows) == len(texts)

    def texts_match(model, theirs, mine):
        """For each piece of the library whether it stands at the same bytes in mine."""
        at = [np.cumsum([0, *(len(model.bytes_of[i]) for i in ids)]).tolist() for ids in (theirs, mine)]
        mine_at = set(zip(at[1][:-1], at[1][1:], strict=True))
        return [span in mine_at for span in zip(at[0][:-1], at[0][1:], strict=True)]

    for r in rows:
        theirs, their_score = model.by_library(texts[r["doc_id"]])
        theirs = np.frombuffer(theirs, np.int32).tolist()
        assert theirs == library.encode(texts[r["doc_id"]]) and r["score"] >= their_score - 1e-6
        same = sum(texts_match(model, theirs, list(r["ids"])))
        agreed, pieces = agreed + same, pieces + len(theirs)
        assert r["round_trip"] and model.decode(list(r["ids"])) == texts[r["doc_id"]]
        assert r["n_best"] == len(set(r["best_sha256"])) and r["best_sha256"][0] == r["ids_sha256"] and list(r["best_scores"]) == sorted(r["best_scores"], reverse=True)

    assert agreed >= 0.6 * pieces, agreed / pieces

    def every(rest):
        if not rest:
            yield 0.0, []
        for k in range(1, len(rest) + 1):
            known = model.scores.get(rest[:k]) or ((model.unknown, -1) if k == 1 else None)
            for score, ids in every(rest[k:]) if known else ():
                own = [known[1]] if known[1] >= 0 else [model.id_of_byte[b] for b in rest[:1].encode()]
                yield known[0] + score, own + ids

    some = sorted({s for t in texts.values() for s in model.split(t) if len(s) <= piece_lattice.MEMO_CHARS})[::7] + ["\ud800x", "▁▁▁"]
    for text in some:
        one, many = model._analyse(text), model.analyse_many([text, text[::-1]])[0]
        assert (one.ids, one.same) == (many.ids, many.same) and one.score == pytest.approx(many.score) and one.loss == pytest.approx(many.loss)
    for text in ("a cat", "the then", "in-out", "  two ", "日本é", "unlike", "aaaa", "x\ny"):
        want = sorted(every(model.normalise(text)), key=lambda w: -w[0])
        got = model.n_best(text, 6)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]])
        assert all(any(ids == i and abs(s - t) < 1e-9 for t, i in want) for s, ids in got)


def test_pieces_of_all_segmentations(spark, monkeypatch):
    monkeypatch.setattr(piece_lattice, "HELD_CHARS", 30)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = {20: "unbelievable transmogrification", 21: "日本語の🙂 tab\tnew\nline", 22: "a", 23: "  two  blanks ", 24: "x" * 40, 25: "▁ab", 1: None, 2: ""}
    got = {r["doc_id"]: r for r in piece_lattice.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), path).collect()}
    model = piece_lattice.load(path)
    assert sorted(got) == sorted(texts)
    for k, text in texts.items():
        r, want = got[k], model.n_best(text or "", 4)
        assert r["best_scores"] == pytest.approx([s for s, _ in want]) and len(r["segmentations"]) == r["n_best"] == len(want)
        assert sorted(map(list, r["segmentations"])) == sorted(ids for _, ids in want) or len({s for s, _ in want}) < len(want)
        assert len({tuple(ids) for ids in r["segmentations"]}) == r["n_best"]
        assert all(model.decode(ids) == r["decoded"] for ids in r["segmentations"]) and r["round_trip"] == (r["decoded"] == (text or "")) == (k != 25)
        assert hashlib.sha256(np.array(r["segmentations"][0], np.int32).tobytes()).hexdigest() == r["ids_sha256"]


def test_every_width_is_searched_by_itself(spark):
    make = np.random.default_rng(5)
    data = [(k, make.standard_normal(16 if k % 3 else 7).tolist()) for k in range(900)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("width", "chunk", "copy")})
    got: dict[int, list] = {}
    for r in collision_ann.search(df, F.col("vec_id") % 50 == 0, block_rows=200, query_rows=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    assert sorted(got) == list(range(0, 900, 50))
    for q, found in got.items():
        v = np.array(data[q][1])
        score = {k: float(v @ np.array(x) / np.linalg.norm(v) / np.linalg.norm(x)) for k, x in data if len(x) == len(v) and k != q}
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-12 for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(sorted(score, key=lambda k: (-score[k], k))[:5]))
    assert hit >= 0.9 * 5 * len(got)


def test_keep_bitmaps_of_many_runs(spark):
    lines = [f"a line that repeats {k}" if k % 2 else f"own line {k}" for k in range(3000)]
    first = "\n".join(f"a line that repeats {k}" for k in range(1, 3000, 2))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, first), (2, "\n".join(lines))], "doc_id long, text string")).collect()}
    assert got[1]["keep_bitmap"] == [1500] and got[2]["keep_bitmap"] == [1] * 3000 and got[2]["kept_text"] == "\n".join(lines[::2])
