"""What workers hold between batches and tasks."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallywork.llm import piece_lattice, shared


def test_remembered_segments_are_few_bytes_and_the_same(monkeypatch):
    monkeypatch.setattr(piece_lattice, "MEMO", 300)
    model = piece_lattice.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    word = lambda k: f"w{k * 7919 % 1000}日é\x00" + "x" * (k % 60)
    for first in (0, 100, 50, 0):
        segments = [piece_lattice.BLANK + word(k) for k in range(first, first + 250)]
        got = model.analyse(pa.array([s.encode() for s in segments], pa.large_binary()))
        ids = np.split(got.ids, np.cumsum(got.size)[:-1])
        for k, want in enumerate(map(model._analyse, segments)):
            assert (ids[k].tobytes(), bool(got.same[k])) == (want.ids, want.same)
            assert (got.score[k], got.loss[k]) == pytest.approx((want.score, want.loss))
        memo = model.memo
        kept = memo.text.to_pylist()
        assert len(kept) == len(set(kept)) <= 300 and max(map(len, kept)) <= piece_lattice.MEMO_CHARS
        assert memo.text.nbytes + sum(c.nbytes for c in memo[1:]) <= 250 * len(kept)


def test_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    run = shared.tidy(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and len(calls) == 1
    part = run(iter([1, 2]))
    assert next(part) == 2 and len(calls) == 1
    part.close()
    assert len(calls) == 2
    monkeypatch.undo()
    shared.give_back()
