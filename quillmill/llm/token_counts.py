"""Token counts by section: whole documents are encoded once, and token spans meet section spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder


def sections_of_lines(text: str) -> np.ndarray:
    """Where the lines of a text begin; a newline belongs to the line that it ends."""
    flat = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.flatnonzero(flat == 10) + 1])


def attribute(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, n_chars: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and the number of tokens that cross a boundary.

    begins: where sections begin, ascending from 0; each reaches to the next. A token that crosses a boundary counts
    for the section of its first character (rule "first"), of its last one ("last"), or for the one that holds most of
    it, the earlier at a tie ("most"). Tokens that hold only a part of a character count where that character is.
    """
    before = np.searchsorted(starts, begins[1:], "left")  # tokens that begin before each boundary
    counts = np.diff(np.concatenate([[0], before, [len(starts)]]))
    crossing = {int(t) for t, b in zip(before - 1, begins[1:]) if t >= 0 and ends[t] > b}
    if rule != "first":
        borders = np.append(begins, n_chars)
        for t in crossing:
            first, last = (int(np.searchsorted(begins, c, "right")) - 1 for c in (starts[t], ends[t] - 1))
            held = [min(ends[t], borders[s + 1]) - max(starts[t], borders[s]) for s in range(first, last + 1)]
            counts[first] -= 1
            counts[last if rule == "last" else first + int(np.argmax(held))] += 1
    return counts, len(crossing)


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", sections=sections_of_lines) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_sections, n_crossing and section_tokens (one count for each section, in order).

    Each whole document is encoded once: word by word, each word that a worker has met before taken from its table (see
    tokens), which gives the ids and offsets of the library's ``encode``. The sum of section_tokens is n_tokens: each
    token counts once. A null or empty text is one empty section without
    tokens. Null and repeated ids keep their rows. Further columns are ignored; an empty table gives no rows.
    """
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")

    def count(parts):
        known = encoder(tokenizer, True)
        for batch in parts:
            for k in range(0, batch.num_rows, 500):
                ids, texts = (batch.slice(k, 500).column(c) for c in (0, 1))
                rows = []
                for text in texts.to_pylist():
                    text = text or ""
                    counts, crossing = attribute(*known.spans(text), sections(text), len(text), rule)
                    rows.append((len(text), int(counts.sum()), len(counts), crossing, counts))
                n_chars, n_tokens, n_sections, n_crossing, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_chars, n_tokens, n_sections, n_crossing)), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    return section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
