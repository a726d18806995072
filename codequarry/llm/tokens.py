"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codequarry.llm.caches import cache, claim
from codequarry.llm.common import id_and_text

BATCH_BYTES = 1 << 20
CACHED_UNITS = 600_000
CACHED_CHARS = 64
#: Units end where ASCII white space follows something else, or where one of these signs follows a letter or digit. No
#: token reaches over such a place: patterns take white space only at the start of a match and never mix letters with
#: signs, and special strings hold neither white space nor these signs after a letter.
SIGNS = '.,;:!?*%&$#"()'
PLAIN = rf"[^\W_]++(?=[{re.escape(SIGNS)}]|[ \t-\r]|\Z)"
UNIT = re.compile(rf" ?{PLAIN}|\s*\S+(?:[^\S \t-\r]\s*\S+)*|\s+")
OTHER_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LOADED: dict[str, object] = {}


def loaded(name: str):
    """The tokenizer of a process, by the name of its file."""
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = public_tokenizers.path(name) if not os.path.isabs(name) else name
        if name.endswith(".model"):
            import sentencepiece

            _LOADED[name] = sentencepiece.SentencePieceProcessor(model_file=str(path))
        else:
            from tokenizers import Tokenizer

            _LOADED[name] = Tokenizer.from_file(str(path))
    return _LOADED[name]


def in_byte_batches(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about equal bytes; a text larger than the limit is a batch of its own."""
    batch: list[str] = []
    size = 0
    for text in texts:
        n = len(text) * 4 if not text.isascii() else len(text)
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()


def in_byte_letters(unit: str) -> str:
    """Of a unit of letters, signs and spaces: in ASCII, only the space is written otherwise."""
    if unit.isascii():
        return unit.replace(" ", LETTERS[32])
    return "".join([LETTERS[b] for b in unit.encode()])


def is_single(part: str) -> bool:
    """Letters alone or signs alone: one pre-token, which can go straight to the merges."""
    return part.isalpha() or not part.strip(SIGNS)


class Encoder:
    """Encodes units in batches and remembers short ones, since words repeat: at most two generations of ``bound`` units."""

    def __init__(self, encode: Callable[[list[str]], list], split: Callable[[str], list[str]], bound: int = CACHED_UNITS):
        self.encode, self.split, self.bound = encode, split, bound
        self.known: dict = {}
        self.older: dict = {}

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text what its units are encoded as."""
        if len(self.known) > self.bound:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [self.split(t) for t in texts]
        missing = set().union(*split) - known.keys()
        again = missing & older.keys()
        known.update((u, older[u]) for u in again)
        for batch in in_byte_batches(missing - again):
            known.update(zip(batch, self.encode(batch)))
        out = [list(map(known.__getitem__, units)) for units in split]
        for unit in missing:
            if len(unit) > CACHED_CHARS:
                del known[unit]
        return out


def spaced(text: str) -> list[str]:
    """What single spaces separate, as it stands for a unit with a space before it; any other unit gets a space as a mark."""
    simple = "  " not in text and "\n " not in text and text[-1:] != " " and text[:1] != " " and not any(c in text for c in OTHER_SPACES)
    if not simple:
        return [" " + u for u in UNIT.findall(text)]
    units = text.split(" ")
    units[0] = " " + units[0]
    return units


_ENCODERS: dict[str, Encoder] = cache("token counts")


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Lengths of the encodings of whole texts."""
    tokenizer = loaded(name)
    if name.endswith(".model"):
        # a sentencepiece model may normalise white space across words, so its texts are not split
        return lambda texts: [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    if name not in _ENCODERS:
        tokenize = tokenizer.model.tokenize

        def lengths(units: list[str]) -> list[int]:
            parts = [UNIT.findall(u[1:] if u[0] == " " else " " + u) for u in units]
            single = [[is_single(p[1:] if p[0] == " " else p) for p in found] for found in parts]
            batch = [p for found, flags in zip(parts, single) for p, s in zip(found, flags) if not s]
            rest = iter(tokenizer.encode_batch_fast(batch, add_special_tokens=False))
            return [sum(len(tokenize(in_byte_letters(p))) if s else len(next(rest)) for p, s in zip(found, flags)) for found, flags in zip(parts, single)]

        _ENCODERS[name] = Encoder(lengths, spaced)
    encoder = _ENCODERS[name]
    return lambda texts: [sum(x) for x in encoder(texts)]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts, null counting as empty (0 bytes, 0 tokens). Byte-level tokenizers see units cut at safe boundaries,
    in batches of about a megabyte; text without white space is one unit. Special strings inside a text hold no white
    space, so they stay whole and are handled as the library's default does. Repeated rows, null ids and ties pass
    through; other columns are ignored; an empty table gives no rows. There is no shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token counts")
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = np.fromiter((n for part in in_byte_batches(texts) for n in count(part)), dtype=np.int64, count=len(texts))
            sizes = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
