"""Decontamination on random tables against a plain version of all its rules: short items, contradicting slots, places."""

import random
import re
from collections import defaultdict

from tallywork.llm import decontaminate as D

SCHEMA = "{}_id long, text string"


def tokens(text):
    raw = re.findall(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+|[.!?]", text or "")
    mark, number = lambda w: w in (".", "!", "?"), lambda w: w is not None and w[0].isdigit()
    capital = lambda w, before: w is not None and w[0] != w[0].lower() and before is not None and not mark(before)
    out = []
    for k, w in enumerate(raw):
        one, two = (raw[k - j] if k >= j else None for j in (1, 2))
        if mark(w):
            c = None
        elif number(w):
            c = "#number"
        elif number(one) and w.lower() in D.UNITS:
            c = "#unit"
        elif capital(w, one):
            c = None if capital(one, two) else "#name"
        else:
            c = w.lower()
        if c:
            out.append((c, w.lower()))
    return out


def windows(ts):
    return [(k, tuple(c for c, _ in ts[k : k + 5])) for k in range(len(ts) - 4)]


def judge(values):
    """most, n_slots, n_changed of (kind, item_value, item_pos, doc_value)."""
    groups = defaultdict(lambda: (set(), set()))
    for kind, item_value, pos, value in values:
        groups[kind, item_value][0].add(pos)
        groups[kind, item_value][1].add(value)
    most = max((len(v) for _, v in groups.values()), default=1)
    return most, sum(len(p) for p, _ in groups.values()), sum(len(p) for (_, own), (p, v) in groups.items() if min(v) != own)


def plain(docs, items, percent=80):
    out = set()
    item_tokens = {i: tokens(t) for i, t in items}
    wanted = {i: [(k, g) for k, g in windows(ts) if sum(c[0] == "#" for c in g) <= 2] for i, ts in item_tokens.items()}
    said = lambda t: " " + " ".join(w for w in re.findall(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+", (t or "").lower())) + " "
    for d, text in docs:
        ts = tokens(text)
        own = defaultdict(list)
        for k, g in windows(ts):
            own[g].append(k)
        for i, item in items:
            if not wanted[i]:
                words = said(item).split()
                if words and said(item) in said(text):
                    out.add((d, i, 1, 1, sum(w[0].isdigit() for w in words), 0))
                continue
            size = len({g for _, g in wanted[i]})
            hits = {(pos, k, g) for k, g in wanted[i] for pos in own.get(g, [])}
            if 100 * len({g for *_, g in hits}) < percent * size:
                continue
            faced = {(pos + j, k + j) for pos, k, _ in hits for j in range(5)}
            slots = {(pos, k, item_tokens[i][k][0], item_tokens[i][k][1], ts[pos][1]) for pos, k in faced if item_tokens[i][k][0][0] == "#"}
            most, n_slots, n_changed = judge([(kind, v, k, w) for _, k, kind, v, w in slots])
            if most <= 1:
                out.add((d, i, size, len({g for *_, g in hits}), n_slots, n_changed))
                continue
            best = None
            offsets = {pos - k for pos, k, _ in hits}
            places = [(0, o, {o}) for o in offsets] + [(D.SLACK, a, set(range(a, a + D.SLACK + 1))) for a in {o - s for o in offsets for s in range(D.SLACK + 1)}]
            for _, _, held in places:
                matched = len({g for pos, k, g in hits if pos - k in held})
                most, n, changed = judge([(kind, v, k, w) for pos, k, kind, v, w in slots if pos - k in held])
                if 100 * matched >= percent * size and most <= 1:
                    best = max(best or (0,), (matched, -changed, n))
            if best:
                out.add((d, i, size, best[0], best[2], -best[1]))
    return out


def vary(pick, words):
    """The same words with other numbers and names, or with a word less, more or changed."""
    swap = {str(k): str(pick.choice([k, k, k + 1])) for k in range(10)} | {n: pick.choice([n, n, "Eve"]) for n in ("Ann", "Bob")}
    out = [swap.get(w, w) if pick.random() < 0.97 else pick.choice("7 Eve cat".split()) for w in words]
    if pick.random() < 0.2:
        del out[pick.randrange(len(out))]
    return out


def test_random_tables_against_the_plain_rules(spark):
    pick = random.Random(17)
    vocabulary = "cat dog sun tree runs kg to the of near".split() + ["Ann", "Bob", "3", "8", "1.5", "."]
    sentence = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(sentence(pick.choice([1, 3, 4, 6, 9, 14, 14])))) for k in range(40)] + [(50, None), (51, ""), (52, "!"), (53, "3 8 3 8 3 8 3"), (None, "the cat runs to the sun near Ann")]
    items += [(60, items[5][1]), (60, items[5][1])]
    docs = []
    for k in range(150):
        parts = []
        for _ in range(pick.randint(0, 4)):
            item = pick.choice(items)[1]
            parts += [sentence(pick.randint(0, 6)), vary(pick, item.split()) if item and item.split() else []]
        docs.append((k, " ".join(w for p in parts for w in p)))
    docs += [(200, None), (201, ""), (None, docs[0][1]), (3, docs[3][1])]
    got = D.contaminated(spark.createDataFrame(docs, SCHEMA.format("doc")).repartition(3), spark.createDataFrame(items, SCHEMA.format("item")))
    rows = [tuple(r[c] for c in ("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_changed")) for r in got.collect()]
    known = lambda pairs: sorted({p for p in pairs if p[0] is not None}, key=str)
    want = plain(known(docs), known(items))
    assert len(rows) == len(set(rows)) and set(rows) == want
    # The rules at stake all occur.
    assert any(r[2] == 1 and r[5] == 0 for r in want) and any(r[5] > 0 for r in want) and len(want) > 100


def test_a_hot_template_window(spark):
    item = "how many apples does Ann have after she buys 3 more"
    docs = [(k, f"how many apples does Bob have after he sells {k} of them") for k in range(2000)] + [(5000, item), (5001, item.replace("3", "9").replace("Ann", "Eve"))]
    got = D.contaminated(spark.createDataFrame(docs, SCHEMA.format("doc")), spark.createDataFrame([(1, item)], SCHEMA.format("item")))
    assert sorted((r["doc_id"], r["n_changed"]) for r in got.collect()) == [(5000, 0), (5001, 2)]


def test_long_runs_of_names_and_of_numbers(spark):
    item = "the cat sits near 1,22,1 and looks at Ann while the sun is up"
    names = " ".join(["Bob", "Eve Cat"] * 30_000)
    docs = [(1, f"{item} {names}. {item}"), (2, f"see 3 KG {names} {item}"), (3, f"{'1,22,' * 60_000}1 {item}"), (4, item.replace("1,22,1", "7," * 60_000 + "7").replace("Ann", names)), (5, names)]
    got = D.contaminated(spark.createDataFrame(docs, SCHEMA.format("doc")), spark.createDataFrame([(1, item), (2, "the cat")], SCHEMA.format("item")))
    assert {tuple(r) for r in got.select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_changed").collect()} == plain(docs, [(1, item), (2, "the cat")])
