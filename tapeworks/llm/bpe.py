"""BPE encoding and decoding with forced boundaries.

Two bytes that are neighbours in no token of the vocabulary can't be merged across, so a cut between them is certain.
Texts are cut where a character that is not white space precedes white space, if the vocabulary forces a boundary between
those bytes (there the pre-tokenizer ends a piece too). Each distinct fragment is cut on between any two letters, of
whatever script, whose neighbouring bytes no token holds: letters of one run are one piece to the pre-tokenizer, so there
the vocabulary alone decides. The parts are encoded on their own, once for each fragment, and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm.common import python_rows, table

VOCABULARY = "byte_bpe_50k.json"
WHITE_BYTES = b"\t\n\x0b\x0c\r "
#: Remembered fragments in a worker; all are forgotten when there are more.
MEMORY = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encodes and decodes whole texts as the tokenizer in `path` does, fragment by fragment."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model.get("added_tokens", [])}
        joined = set()
        for token in model["model"]["vocab"]:
            if token not in special:
                raw = bytes(alphabet[c] for c in token)
                joined.update(zip(raw, raw[1:], strict=False))
        #: Pairs of bytes inside some token: everything else is a forced boundary.
        self.joined = joined
        self.cut = re.compile(self._pattern(), re.ASCII)
        letters = [chr(b) for b in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
        #: Pairs of ASCII letters that are cut.
        self.apart = frozenset(a + b for a in letters for b in letters if (ord(a), ord(b)) not in joined)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.known: dict[str, tuple[str, int, str]] = {}

    def _pattern(self) -> str:
        """Fragments: white space, then everything up to the next white space that a forced boundary precedes."""
        inside = "".join(re.escape(chr(w)) for w in WHITE_BYTES)
        # Last bytes that some token joins with white space: after their characters (and all beyond the BMP) nothing is cut.
        tied = {b for b, w in self.joined if w in WHITE_BYTES and b not in WHITE_BYTES}
        if not tied:
            return f"[{inside}]*[^{inside}]+|[{inside}]+"
        loose = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (c if c < 0x80 else 0x80 | c & 0x3F) in tied)
        return f"[{inside}]*[^{inside}]+(?:(?<=[{re.escape(loose)}\U00010000-\U0010ffff])[{inside}]+[^{inside}]+)*|[{inside}]+"

    def fragments(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def parts(self, fragment: str) -> list[str]:
        """The fragment cut between letters at forced boundaries."""
        if fragment.isascii():
            if self.apart.isdisjoint(map(add, fragment, fragment[1:])):
                return [fragment]
            cuts = [i for i in range(1, len(fragment)) if fragment[i - 1 : i + 1] in self.apart]
        else:
            raw = [c.encode("utf-8", "surrogatepass") for c in fragment]
            cuts = [i for i in range(1, len(raw)) if (raw[i - 1][-1], raw[i][0]) not in self.joined and fragment[i - 1].isalpha() and fragment[i].isalpha()]
        if not cuts or self.special.search(fragment):
            return [fragment]
        return [fragment[a:b] for a, b in zip([0, *cuts], [*cuts, len(fragment)], strict=True)]

    def encode(self, text: str) -> list[int]:
        self._learn([text])
        return [int(i) for x in self.fragments(text) if (ids := self.known[x][0]) for i in ids.split(",")]

    def _learn(self, texts: list[str]) -> list[list[str]]:
        parts = [self.fragments(x) for x in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list(set().union(*parts).difference(self.known))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            parts_of = [self.parts(x) for x in some]
            flat = iter(self.tokenizer.encode_batch_fast([y for x in parts_of for y in x], add_special_tokens=False))
            ids = [next(flat).ids if len(x) == 1 else [i for _ in x for i in next(flat).ids] for x in parts_of]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            for x, i, b in zip(some, ids, back, strict=True):
                self.known[x] = (",".join(map(str, i)), len(i), b)
        return parts

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, SHA-256 of its ids, SHA-256 of what they decode to."""
        out = []
        for part in self._learn(texts):
            ids, counts, back = zip(*map(self.known.__getitem__, part), strict=True) if part else ((), (), ())
            out.append((sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256("".join(back).encode()).hexdigest()))
        return out


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """One codec for each worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_documents(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; null text is empty, empty text has no ids. Other columns are ignored."""
    python_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": pd.Series([codec(path or default_path()).encode(t or "") for t in batch["text"]], dtype=object)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [[] if x is None else list(map(int, x)) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": codec(path or default_path()).tokenizer.decode_batch(ids, skip_special_tokens=False)})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: ids are made, hashed and decoded in the worker.

    Null text is empty; an empty text has no ids. Repeated rows each get a row, a null doc_id stays null. Other columns are
    ignored; an empty table gives no rows. Without a path each worker takes the vocabulary installed where it runs.
    """
    python_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = codec(path or default_path()).digest([t or "" for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return encoding_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
