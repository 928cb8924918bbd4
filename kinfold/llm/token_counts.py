"""Token counts by offset-mapped attribution.

Each document (its fields joined by a line feed) is encoded once, whole. The tokens of a byte-level vocabulary cover
its bytes without gaps, so their byte spans are running sums of token lengths; the sections are the lines of the
fields, with their line feeds. Token spans are joined to section spans by binary search over section starts.

Rule for tokens that cross a boundary: a token belongs to the section that holds its first byte; ``crossing`` counts
those of a section's tokens that end in a later one. So the counts of a document's sections add up to its tokens.

Long runs of white space are cut off before the split pattern sees them, at places where it would cut too, and encoded as
pieces of their own: the pattern's engine keeps a stack that grows with such a run, and fails on a million blanks.

Defined cases: a null field counts as empty; a document without text has one section without tokens; repeated rows are
counted each; an empty table gives an empty result; extra columns are ignored, clashing names are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._kernel import slices
from kinfold.llm._store import small_batches

#: Rank file of a public byte-level vocabulary, and the split pattern that goes with it (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern's engine has it (fixed values), in runs that are long for its stack.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

SCHEMA = "doc_id long, section int, field int, char_start long, char_end long, tokens long, crossing long"


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    length = np.zeros(max(table.values()) + 1, np.int64)
    for token, i in table.items():
        length[i] = len(token)
    return tiktoken.Encoding("kinfold", pat_str=pattern, mergeable_ranks=table, special_tokens={}), length


def encode(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The token ids of a text.

    The pattern takes a run of white space but for its last character, which it leaves to what follows; at the end of a
    text it takes all of it. Nothing else can hold two characters of a run, so these are the pattern's own cuts.
    """
    found, at = [], 0
    for run in _LONG_RUN.finditer(text):
        a, z = run.start(), run.end() - (run.end() < len(text))
        found.append(encoding.encode_to_numpy(text[at:a], disallowed_special=()))
        found.append(np.asarray(encoding._encode_single_piece(text[a:z]), np.uint32))
        at = z
    found.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(found) if at else found[0]


def _count(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = _encoder(ranks, pattern)
        for rows, flat, offs in slices(batches, "text"):
            lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
            feeds = np.flatnonzero(flat == 10)
            ids, firsts = rows.column("doc_id"), rows.column("first_fields").to_pylist()
            parts: list[tuple] = []
            for d, text in enumerate(rows.column("text").to_pylist()):
                a, z = offs[d], offs[d + 1]
                own = feeds[np.searchsorted(feeds, a) : np.searchsorted(feeds, z)] + 1
                begin = np.concatenate([[a], own[own < z]]) if z > a else np.array([a])
                token = length[encode(encoding, text)] if text else np.zeros(0, np.int64)
                end = a + np.cumsum(token)
                section = np.searchsorted(begin, end - token, "right") - 1
                stop = np.append(begin[1:], z)
                field = np.searchsorted(np.asarray(firsts[d], np.int64), lead[begin] - lead[a], "right") - 1
                parts.append((np.full(len(begin), d), np.arange(len(begin)), field, lead[begin] - lead[a], lead[stop] - lead[a], np.bincount(section, minlength=len(begin)), np.bincount(section[end > stop[section]], minlength=len(begin))))
            doc, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            types = [pa.int32(), pa.int32()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *(pa.array(x.astype(np.int64)).cast(t) for x, t in zip(rest, types, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per section of each document: its code points from and to, its tokens, and how many of these cross its end."""
    small_batches(docs.sparkSession)
    ranks = Path(vocabulary).read_bytes()  # on the driver; under a megabyte travels with the tasks
    body = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    begin, firsts = F.lit(0).cast("long"), []
    for b in body:
        firsts.append(begin)
        begin = begin + F.length(b) + 1
    rows = docs.select("doc_id", F.concat_ws("\n", *body).alias("text"), F.array(*firsts).alias("first_fields"))
    return rows.mapInArrow(_count(ranks, pattern), SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's lines, its language and source as fields before its text."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"), ("lang", "source", "text"))
