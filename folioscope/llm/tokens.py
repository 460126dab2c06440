"""Token ids of whole texts by public tokenizers, with a bounded cache of pieces.

A text is cut only where the tokenizer's own first split always cuts, so that the ids of the pieces, one after
another, are the ids of the text.  Words of invented or natural prose recur; a piece that was seen before costs one
dictionary look-up.  The caches belong to a Python worker and have a fixed number of entries.

Ids are kept as little-endian unsigned 16-bit numbers where the vocabulary allows it, else 32-bit.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from .common import KEPT

#: White space as the tokenizers' patterns see it (fixed values: the Unicode property White_Space).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space and what follows it up to white space; or white space but the last before a word; or white space.
_SPACED = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
#: Texts, or pieces, of only these characters are cut here as the tokenizers' own patterns cut them: printable ASCII and
#: letters of Latin-1, which no normaliser but lower-casing changes, and ASCII white space.
_PLAIN = re.compile("[\\t-\\r\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Fixed values of the public byte-level patterns: English contractions come first.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PARTS = {
    "spaces": re.compile(f"{_SHORT}| ?[{_LETTER}]+| ?[0-9]+| ?[^ \\t-\\r{_LETTER}0-9]+|[ \\t-\\r]+(?![^ \\t-\\r])|[ \\t-\\r]+"),
    "words": re.compile(f"{_SHORT}|[{_LETTER}]+|[0-9]|[^ \\t-\\r{_LETTER}0-9]+"),
}
#: Entries in a generation: pieces are cheap to make from their parts, parts are not.
_PIECES, _KEPT_PARTS = 20_000, 300_000


def _byte_alphabet() -> list[str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others follow from U+0100 in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


class _Aged(dict):
    """A bounded cache of two generations: what is asked for again outlives the older one."""

    def __init__(self, make, most: int):
        super().__init__()
        self._old: dict = {}
        self._make, self._most = make, most

    def __missing__(self, key):
        got = self._old.get(key)
        if got is None:
            got = self._make(key)
        if len(key) <= 48:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Gives the ids of whole texts."""

    def __init__(self, path: str, cut: str):
        import tokenizers

        self._tokenizer = tokenizers.Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._marks = [str(s.content).encode() for s in self._tokenizer.get_added_tokens_decoder().values()]
        self._spaces = cut == "spaces"
        self._split = _PARTS[cut].findall
        self._tokens = self._tokenizer.model.tokenize
        self._code = "H" if self.dtype.itemsize == 2 else "I"  # little-endian machines
        self._bytes = dict(enumerate(_byte_alphabet()))
        self._parts = _Aged(self._part, _KEPT_PARTS)
        self._pieces = _Aged(self._piece, _PIECES)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            mapped = part.replace(" ", self._bytes[32])
        else:
            mapped = part.encode().decode("latin-1").translate(self._bytes)
        return array(self._code, [t.id for t in self._tokens(mapped)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._parts.__getitem__, self._split(text if self._spaces else text.lower())))

    def _piece(self, piece) -> bytes:
        text = piece if self._spaces else piece.decode()
        return self._plain(text) if len(text) < 1000 and _PLAIN.fullmatch(text) else self._whole(text)

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text (UTF-8), as bytes of ``dtype``."""
        whole = text.decode()
        if any(m in text for m in self._marks):  # a special token's string may lie across pieces
            return self._whole(whole)
        if _PLAIN.fullmatch(whole):
            return self._plain(whole)
        return b"".join(map(self._pieces.__getitem__, _SPACED.findall(whole) if self._spaces else text.split()))


_LOADED: dict[str, Encoder] = {}
KEPT.append(_LOADED)


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file.

    Byte-level BPE that keeps white space is cut at spaces; the kind that drops it, at ASCII white space.  Files of
    any other kind are refused: for them it isn't known where a text may be cut.
    """
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        parts = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            cut = "spaces"
        elif [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [q.get("type") for q in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed":
            cut = "words"
        else:
            raise ValueError(f"no safe cut is known for the tokenizer {path}")
        _LOADED[path] = Encoder(path, cut)
    return _LOADED[path]


def public_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_rows(df, path: str, end_id: int, id_column: str = "doc_id", text: str = "text"):
    """``id_column, part, start_in_part, n_tokens, ids``: each text's ids and the end id, as bytes.

    ``part`` is the task's number and ``start_in_part`` the ids before the row in its task: write the result before
    use, so that both hold.  A null text counts as empty.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from .common import text_bytes, tidied

    def run(batches):
        enc = encoder(path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [enc.ids(t) + end for t in batch.column(1).to_pylist()]
            n = np.fromiter((len(x) // enc.dtype.itemsize for x in ids), np.int64, len(ids))
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"]
            )

    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_bytes(text).alias("bytes"))
    return rows.mapInArrow(tidied(run, keeps=True), "doc_id long, part long, start_in_part long, n_tokens long, ids binary")


def id_type(path: str) -> np.dtype:
    return encoder(path).dtype
