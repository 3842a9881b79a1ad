"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded; a gated attention layer, learned from the documents' labels
alone, weighs them; and the weighted sum of the codes is scored. Fitted in numpy on a bounded sample; scored by Spark
over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

#: Words of a passage.
PASSAGE = 64
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by case, digits, spaces, newlines, bytes beyond ASCII, each other sign its own."""
    table, n = np.zeros(256, np.int64), 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 5
        elif "a" <= c <= "z":
            table[b] = 0
        elif "A" <= c <= "Z":
            table[b] = 1
        elif c.isdigit():
            table[b] = 2
        elif c in "\t\x0b\x0c\r ":
            table[b] = 3
        elif c == "\n":
            table[b] = 4
        elif c.isprintable():
            table[b], n = n, n + 1
        else:
            table[b] = 3
    return table, n


CLASS, N_CLASSES = _classes()
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
MIX = np.random.default_rng(5).integers(-(2**62), 2**62, (16, 256), dtype=np.int64)
N_FEATURES = N_CLASSES + 7


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the number of passages of each text (1 at least).

    Features are shares of byte classes (their square roots), and of words: mean and spread of length, distinct words,
    distinct words against the one before, capitals, and the passage's length. A text without words is one passage of
    zeros.
    """
    raw = [x.encode("utf-8", "replace") for x in texts]
    data = np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)
    sizes = np.array([len(x) + 1 for x in raw])
    blank = BLANK[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    begin = np.flatnonzero(starts)
    doc_of_byte_0 = np.concatenate([[0], np.cumsum(sizes)])
    first_word = np.searchsorted(begin, doc_of_byte_0)
    n_words = np.diff(first_word)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    offset = np.concatenate([[0], np.cumsum(n_passages)])
    out = np.zeros((offset[-1], N_FEATURES))
    if not len(begin):
        return out, n_passages
    doc = np.repeat(np.arange(len(texts)), n_words)
    passage = offset[doc] + (np.arange(len(begin)) - first_word[doc]) // PASSAGE
    ends = np.append(begin[1:], len(data))
    # a word's bytes reach to the next word, or to the end of its text: what neighbours in a batch begin with is theirs
    own = np.arange(begin[0], len(data)) < np.repeat(doc_of_byte_0[doc + 1], ends - begin)
    of_byte = np.repeat(passage, ends - begin)[own]
    counts = np.bincount(of_byte * N_CLASSES + CLASS[data[begin[0] :][own]], minlength=len(out) * N_CLASSES).reshape(len(out), N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(data)]])))
    mixed = MIX[place & 15, data]
    mixed[blank] = 0
    word = np.add.reduceat(mixed, begin)
    length = np.add.reduceat((~blank).astype(np.int64), begin)
    n = np.maximum(1, np.bincount(passage, minlength=len(out)))
    mean = np.bincount(passage, length, len(out)) / n
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length.astype(float) ** 2, len(out)) / n - mean**2))

    def distinct(key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, passage))
        p, k = passage[order], key[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        return np.bincount(p[new], minlength=len(out)) / n

    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    capital = CLASS[data[begin]] == 1
    out[:, N_CLASSES:] = np.stack([mean / 8, spread / 8, distinct(word), np.bincount(passage, same, len(out)) / n, np.bincount(passage, capital, len(out)) / n, np.log1p(np.bincount(passage, minlength=len(out))) / 4, np.bincount(passage, length > 20, len(out)) / n], 1)
    return out, n_passages


@dataclass
class Model:
    """Encoder W, b; attention by tanh V and sigmoid U, weighed by w; score by c, d. mean and scale norm the features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.forward(x, np.repeat(np.arange(len(n)), n), starts)["score"]


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> Model:
    """Fits the model by Adam on all bags at once."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    rate_of_1 = np.clip(y.mean(), 0.01, 0.99)
    model = Model(mean, scale, {"W": draw(x.shape[1], hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.array(np.log(rate_of_1 / (1 - rate_of_1)))})
    starts, bag, p = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n), model.p
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, bag, starts)
        d_out = (f["score"] - y) / len(y)
        d_z = d_out[:, None] * p["c"]
        d_a = (d_z[bag] * f["h"]).sum(1)
        d_e = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, starts)[bag])
        d_t, d_g = d_e[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), d_e[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = (f["a"][:, None] * d_z[bag] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - f["h"] ** 2)
        grad = {"W": f["x"].T @ d_h, "b": d_h.sum(0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_e, "c": f["z"].T @ d_out, "d": d_out.sum()}
        for k in p:
            grad[k] = grad[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_passages: int = 40_000) -> Model | None:
    """Fits on the ``sample`` labelled documents that come first by a hash of doc_id, none of them held out.

    Of these, as many as have ``most_passages`` passages together (each with its whole text; the first always): in that
    order those of a hundredth of that at most, then longer ones, the shortest first. So no long text takes the place of
    many. Where that leaves documents out, and room for one of a hundredth or more, further labelled documents in the order
    stand in for those left out. All that bounds what the driver holds. Null labels are left out; where no label
    is left the result is None.
    """
    in_order = labels.where(f"quality is not null and doc_id is not null and not {HELD_OUT}").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
    candidates = sample
    while True:
        some, left_out = _sampled(docs, in_order.limit(candidates), most_passages, None if candidates == sample else sample)
        full = not left_out or len(some) >= sample or sum(r["n"] for r in some) > most_passages - most_passages // 100
        if full or in_order.limit(candidates + 1).count() <= candidates:
            break
        candidates *= 4
    if not some:
        return None
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in some]).astype(float)
    return fit(x, np.array([r["n"] for r in some]), np.array([float(r["quality"] > 0) for r in some]))


def _sampled(docs: DataFrame, chosen: DataFrame, most_passages: int, most_rows: int | None) -> tuple[list, bool]:
    """Rows quality, n (passages) and x (their features) of the chosen documents that fit; and whether any did not."""
    # without ``most_rows`` at most as many rows of two numbers as train's ``sample``: safe to broadcast
    rows = docs.where(f"not {HELD_OUT}").select("doc_id", "text").join(chosen if most_rows else F.broadcast(chosen), "doc_id")
    # of rows that repeat a chosen id one counts, however many there are
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def encode(parts):
        for batch in parts:
            for k in range(0, batch.num_rows, 100):
                for row in batch.slice(k, 100).to_pylist():
                    x, n = passages([row["text"] or ""])
                    yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "quality": row["quality"], "n": int(n[0]), "x": x.astype("<f4").tobytes()}], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("n", pa.int32()), ("x", pa.binary())]))

    schema = StructType.fromDDL("doc_id long, quality int, n int, x binary")
    encoded = rows.selectExpr("cast(doc_id as long) doc_id", "text", "cast(quality as int) quality").mapInArrow(encode, schema)
    by_length = W.orderBy(F.greatest("n", F.lit(most_passages // 100)), F.xxhash64("doc_id"), "doc_id", "quality")
    ranked = encoded.withColumn("upto", F.sum("n").over(by_length.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(by_length))
    fits = f"(upto <= {most_passages} or place = 1)" + (f" and place <= {most_rows}" if most_rows else "")
    # the first that does not fit says that some were left out
    found = ranked.withColumn("fits", F.expr(fits)).withColumn("before", F.coalesce(F.lag("fits").over(by_length), F.lit(True))).where("fits or before")
    found = found.select("quality", "n", F.when(F.col("fits"), F.col("x")).alias("x"), "fits").collect()
    return [r for r in found if r["fits"]], not all(r["fits"] for r in found)


def score(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """doc_id, score of docs (doc_id, text), over whole texts; with ``keep``, all columns of docs and score.

    Null and empty texts have the score of an empty passage. Without a model (no labels) every score is 0.5. Null and
    repeated ids keep their rows; an empty table gives no rows. Without ``keep``, further columns are ignored; with it,
    a column named score is replaced.
    """

    def scores(texts: list[str]) -> np.ndarray:
        k, out = 0, []
        while k < len(texts):
            some, n = [], 0
            while k < len(texts) and (not some or n + len(texts[k]) < 500_000):
                some.append(texts[k])
                n += len(texts[k])
                k += 1
            out.append(model.score(*passages(some)) if model else np.full(len(some), 0.5))
        return np.concatenate(out) if out else np.zeros(0)

    def run(parts):
        for batch in parts:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                found = pa.array(scores([x or "" for x in some.column(at).to_pylist()]), pa.float64())
                columns = [some.column(c) for c in range(some.num_columns)] if keep else [some.column(0)]
                yield pa.RecordBatch.from_arrays([*columns, found], [*(some.schema.names if keep else ["doc_id"]), "score"])

    rows = docs.drop("score") if keep else docs.selectExpr("cast(doc_id as long) doc_id", "text")
    schema = StructType([*(rows.schema.fields if keep else [rows.schema["doc_id"]]), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def op1_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Score and prediction of every document, by a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
