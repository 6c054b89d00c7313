"""Repeated substrings against a plain search over all windows."""

import hashlib
import random

import numpy as np
import pytest

from tallywork.llm import substring_dedup
from tallywork.llm.suffix_array import common_prefixes, new_prefixes, suffix_array, words_at


def plain(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(data) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus() -> list[tuple[int, str | None]]:
    pick = random.Random(5)
    words = ["alpha", "Ünder", "gamma", "delta", "of", "the", "Ωmega", "zeta", "x" * 40]
    make = lambda n: " ".join(pick.choice(words) + str(pick.randint(0, 999)) for _ in range(n))
    passage, long = make(30), make(200)
    rows: list[tuple[int, str | None]] = [(k, make(pick.randint(1, 60))) for k in range(20)]
    rows += [(20 + k, make(pick.randint(0, 9)) + passage[k:] + make(5)) for k in range(12)]
    rows += [(40, long), (41, long), (42, long[:500] + "!" + long[500:]), (43, long[300:900]), (44, long + long), (45, "a" * 700), (46, "b" + "a" * 150), (47, "ab" * 300)]
    rows += [(50, None), (51, ""), (52, "short"), (53, "y" * 99), (54, "y" * 100), (55, "y" * 100), (56, long[:100]), (57, "日本語" * 80)]
    return rows


@pytest.mark.parametrize("most_regions", [50_000, 3])
def test_against_all_windows(spark, monkeypatch, most_regions):
    monkeypatch.setattr(substring_dedup, "MOST_REGIONS", most_regions)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, region string").repartition(3)
    found = substring_dedup.cut(substring_dedup.remove_repeats(df), "found")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
    assert got == plain(rows, 100)
    # The spans themselves, and the bytes that they leave.
    texts, left = {d: (t or "").encode() for d, t in rows}, {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.kept_bytes(df, found).collect()}
    for r in found.collect():
        spans, data = [tuple(s) for s in r["spans"]], texts[r["doc_id"]]
        assert spans == sorted(spans) and len(spans) == r["n_spans"] and sum(b - a for a, b in spans) == r["n_removed"]
        gone = {k for a, b in spans for k in range(a, b)}
        assert left[r["doc_id"]] == bytes(c for k, c in enumerate(data) if k not in gone)
        assert hashlib.sha256(left[r["doc_id"]]).hexdigest() == r["kept_sha256"]


def test_empty_table_null_ids_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    rows = [(1, "q" * 50 + "r" * 120), (1, "q" * 50 + "r" * 120), (None, "r" * 120)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 119), (1, 119)]


def test_suffix_array_orders_by_prefixes():
    pick = random.Random(2)
    for trial in range(120):
        text = np.array([pick.choice([97, 98, 99, 255, 97]) for _ in range(pick.randint(1, 250))], np.uint8)
        if trial % 3 == 0:
            text = np.tile(text[: max(1, len(text) // 7)], 8)
        depth = pick.choice([8, 24, 100])
        words = words_at(text)
        array, data = suffix_array(text, words, depth), text.tobytes()
        keys = [data[k : k + depth] for k in array]
        assert sorted(array) == list(range(len(text))) and keys == sorted(keys)
        pads = [k + bytes(depth - len(k)) for k in keys]
        same = [next((j for j in range(depth) if a[j] != b[j]), depth) for a, b in zip(pads, pads[1:])]
        assert common_prefixes(array, words, depth).tolist()[1:] == same
        assert new_prefixes(array, words, depth).tolist()[1:] == [k < depth for k in same]
        wanted = np.array([pick.random() < 0.2 for _ in text])
        some = suffix_array(text, words, depth, wanted)
        assert set(np.flatnonzero(wanted)) <= set(some.tolist()) and len(set(some.tolist())) == len(some)
        assert [data[k : k + depth] for k in some] == sorted(data[k : k + depth] for k in some)


def test_anchors_count_their_windows():
    pick = random.Random(8)
    for _ in range(60):
        text = bytes(pick.choice(b"ab") for _ in range(pick.randint(99, 900))) + b"c" * pick.choice([0, 300])
        hashes, at, begins, counts = substring_dedup.anchors(text, 100)
        grains = substring_dedup._rolling(np.frombuffer(text, np.uint8), substring_dedup.GRAIN)
        low = np.uint64((1 << len(text).bit_length()) - 1)
        picked = [min(range(k, k + 100 - substring_dedup.GRAIN + 1), key=lambda j: (int(grains[j] & ~low), j)) for k in range(len(text) - 99)]
        assert np.repeat(at, counts).tolist() == picked and begins.tolist() == [picked.index(k) for k in at]
        assert hashes.tolist() == [int(grains[k]) for k in at]


def test_regions_sorted_a_few_at_a_time(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "SORT_BYTES", 300)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == plain(rows, 100)
