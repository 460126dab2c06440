"""What tasks leave in their Python workers."""

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import common, neardup, suffixes, tokens

pytest.importorskip("tokenizers")


class Caught:
    """Stands for a table; gives the function that its rows are to go through."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_deduplication_drops_encoders():
    tokens.encoder(tokens.public_path("word_bpe_49k.json"))
    prefix = pa.array([np.array([5, 6], np.int64).tobytes()], pa.binary())
    out = list(neardup._tokens(Caught())(iter([pa.RecordBatch.from_arrays([pa.array([1]), prefix], names=["id", "prefix"])])))
    assert [b.to_pylist() for b in out] == [[{"token": 5, "id": 1}, {"token": 6, "id": 1}]]
    assert not tokens._LOADED
    tokens.encoder(tokens.public_path("word_bpe_49k.json"))
    assert not list(suffixes._spread(Caught())(iter([])))
    assert not tokens._LOADED


def test_encoding_keeps_encoders():
    path = tokens.public_path("word_bpe_49k.json")
    kept = tokens.encoder(path)
    list(common.tidied(lambda batches: batches, keeps=True)(iter([])))
    assert tokens.encoder(path) is kept


def test_memory_is_given_back_when_a_task_fails(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))

    def run(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(common.tidied(run)(iter([1])))
    assert given == [1]
