"""Encoding of whole texts by a byte-level BPE file of the tokenizers library.

The vocabulary splits a text into pre-tokens before any merge, and a space that has a
non-space beside it (before or after) always starts a pre-token. A text can thus be cut
at its single spaces and each unit encoded alone: the ids are those of the whole text.
A worker keeps the ids of units that it has met twice, so that a frequent word is encoded
once or twice rather than at each place. A text in which white space, a space and white
space follow each other is encoded whole by the library.

New units go to the merge loop of tiktoken, built from the ids of the same file, where
the file's merges stand in the order of their ids (checked when it is loaded) and the
units are Latin text; the library encodes all others. Both give the same ids; the loop
takes a quarter of the time on words that the library has not met.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

_ODD = re.compile(r"\s \s")
_ENCODERS: dict[str, UnitEncoder] = {}


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each id where ids follow the merges; None where they do not, or where the file does more than byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    signs = _byte_signs()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(signs[c] for c in word): k for word, k in model["vocab"].items() if word not in special}
    at = [model["vocab"].get("".join(x if isinstance(x, list) else x.split(" ")), -1) for x in model["merges"]]
    singles = all(bytes([x]) in ranks and ranks[bytes([x])] < 256 for x in range(256))
    return ranks if singles and at == sorted(at) and len(at) == len(ranks) - 256 and at[:1] != [-1] else None


def _latin(unit: str) -> bool:
    """Latin text without white space: what libraries class alike, whichever edition of Unicode they have."""
    return max(unit) < "\u0250" and "\xa0" not in unit and "\x85" not in unit


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    most: units kept at a time; longest: characters of a unit that is kept.
    """

    def __init__(self, path: str, most: int = 60_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}
        self.met = np.zeros(1 << 23, bool)
        self.loop = None
        if ranks := merge_ranks(path):
            self.loop = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for word, k in ranks.items():
                self.sizes[k] = len(word)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own ids."""
        import numpy as np

        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of units that start with a space and end with a non-space: encoded as one text, cut by their bytes."""
        import numpy as np

        ids = np.array(self.loop.encode_ordinary("".join(units)), "<u4")
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)))
        cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, units: list[str]) -> list[str]:
        """Put the ids of " " + unit into known; return the units that shall leave it after this group."""
        import numpy as np

        quick = [x for x in units if x[:1] > " " and x[-1] > " " and (x.isascii() or _latin(x))] if self.loop else []
        if quick:
            self.known.update(zip(quick, self._joined([" " + x for x in quick]), strict=True))
        if len(quick) < len(units):
            taken = set(quick)
            slow = [x for x in units if x not in taken]
            self.known.update(zip(slow, self.whole([" " + x for x in slow]), strict=True))
        at = np.fromiter(map(hash, units), np.int64, len(units)) & (len(self.met) - 1)
        before = self.met[at].tolist()
        self.met[at] = True
        return [x for x, seen in zip(units, before, strict=True) if not seen or len(x) > self.longest]

    def encode(self, texts: list[str]):
        """All ids of the texts, one text's after the other's, and where each text's begin (and the last's end)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        odd = [bool(_ODD.search(x)) for x in texts]
        parts = pc.split_pattern(pa.array(["" if o else x for x, o in zip(texts, odd, strict=True)], pa.large_string()), " ")
        starts = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes, units = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        leave = self._learn([x for x in units if x not in known])
        ids_of = [known[x] for x in units]
        for x in leave:
            del known[x]
        firsts = coded.dictionary.take(coded.indices.take(pa.array(starts[:-1]))).to_pylist()
        codes[starts[:-1]] = np.arange(len(texts), dtype=np.int32) + len(units)
        ids_of += self.whole([x if o else f for x, o, f in zip(texts, odd, firsts, strict=True)])
        lengths = np.fromiter(map(len, ids_of), np.int32, len(ids_of)) // 4
        pool = np.frombuffer(b"".join(ids_of), "<u4")
        per = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
        shift = (np.cumsum(lengths, dtype=np.int64) - lengths)[codes] - ends[:-1]
        at = np.repeat(shift.astype(np.int32), per)
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], ends[starts]


def encoder(path: str) -> UnitEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def encoded(texts: Iterable[str | None], path: str, chars: int = 1_000_000) -> Iterator:
    """Each text's ids as an array of unsigned 32-bit numbers, in order (null: as empty).

    Runs of texts of about `chars` characters are encoded together, which bounds what is held
    if texts are made one by one.
    """
    use, run, size = encoder(path), [], 0
    for x in texts:
        run.append(x or "")
        size += len(run[-1])
        if size >= chars:
            ids, at = use.encode(run)
            yield from (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            run, size = [], 0
    if run:
        ids, at = use.encode(run)
        yield from (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
