"""Language-model scoring with a log-bilinear model, trained by noise-contrastive estimation.

The model predicts a unit from the units before. Each of the HEAD_WORDS most frequent words is a unit with rows of its
own, as context and as target; all other words are dealt by hash into buckets, whose number grows with the root of the
number of such words, and each bucket is a unit. A word of a bucket has its share of the bucket's training tokens, so the
probabilities of all words add to one (with one unseen word in each bucket). Probabilities are normalised in two
steps: the class of the unit, then the unit within its class. The SINGLES most frequent words and the end of a
text are classes alone; neighbours in frequency share the other classes, as many as the root of the number of their units.

Training passes over every training text once, with noise-contrastive steps for classes and for units within their
class: each shard starts from the same parameters, which give unigram probabilities, and each row of the shards' results is
averaged by the number of its uses. Shards are dealt by hash, their number by the training tokens.

Word counts cover all training texts and are made by shuffled sums. The HEAD_WORDS most frequent words travel to the tasks
with their counts (a bounded table); all other words of a text are looked up by a join.

Null and empty texts are one end token. A null doc_id counts as a training text. Rows are numbered once, so repeated rows are
scored each. Without training texts every word is unknown and the model is uniform.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.texts import limit_batches, per_text, slices, written

HEAD_WORDS = 200_000
SINGLES, CONTEXT, WIDTH = 254, 4, 16
NOISE, BATCH, RATE = 32, 1024, 0.15
#: Keeps the first steps of rarely used rows small.
LEAST_STEP = 1e-3
#: Rows of a parameter that are averaged as one record.
BLOCK = 256


def biased(share: np.ndarray) -> np.ndarray:
    """Rows of targets whose last number, the bias, gives them these shares."""
    out = np.zeros((len(share), WIDTH + 1), np.float32)
    out[:, WIDTH] = np.log(share)
    return out


def bucket_count(words: int) -> int:
    """Buckets for so many words without a row of their own."""
    return 8 * math.isqrt(words) + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts, words as bytes; the empty word is the end of a text."""

    def run(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                counts: Counter = Counter()
                for t in texts:
                    counts.update(t.lower().split())
                counts[b""] = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    limit_batches(docs.sparkSession)
    parts = docs.select(F.col("text").cast("binary").alias("whole_text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    """Head words with counts, totals of the corpus and of the buckets of other words, and the parameters."""

    number: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    types: int
    ends: int
    bucket_tokens: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    bucket_types: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        # units: the words of the head, then the buckets, then the end
        self.head, self.buckets = len(self.counts), len(self.bucket_tokens)
        self.end = self.head + self.buckets
        self.bucket_mass = self.bucket_tokens + 0.5 * (self.bucket_types + 1)
        mass = np.concatenate((self.counts + 0.5, self.bucket_mass, [self.ends + 0.5]))
        alone = min(SINGLES, self.head)
        roots = np.sqrt(mass[alone:-1])
        shared = ((np.cumsum(roots) - roots) / roots.sum() * math.ceil(math.sqrt(len(roots)))).astype(np.int64)
        kinds, shared = np.unique(shared, return_inverse=True)
        n = alone + len(kinds) + 1
        self.class_of = np.concatenate((np.arange(alone), alone + shared, [n - 1])).astype(np.int32)
        self.lows = np.searchsorted(self.class_of, np.arange(n + 1))  # units of a class lie together
        class_mass = np.add.reduceat(mass, self.lows[:-1])
        self.class_below, self.below = np.cumsum(class_mass), np.concatenate(([0.0], np.cumsum(mass)))
        self.class_share = (class_mass / class_mass.sum()).astype(np.float32)
        self.share = (mass / class_mass[self.class_of]).astype(np.float32)  # of a unit in its class
        if not self.parameters:
            seen = np.zeros((self.end + 1, WIDTH), np.float32)
            often = np.append(np.arange(alone), self.end)
            seen[often] = np.random.default_rng(7).normal(0, 0.3, (len(often), WIDTH))
            self.parameters = {
                "seen": seen,
                "place": np.full((CONTEXT, WIDTH), 0.5, np.float32),
                "word": biased(self.share),
                "class": biased(self.class_share),
            }

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def sequences(self, texts: list[list[bytes]]):
        """(units of all tokens, the units before, tokens per text)."""
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        get, total = self.number.get, int(sizes.sum())
        units = np.fromiter((get(w, -1) for t in texts for w in (*t, b"")), np.int32, total)
        last = np.cumsum(sizes) - 1
        units[last] = self.end
        absent = np.flatnonzero(units < 0)
        if len(absent):
            words = [w for t in texts for w in (*t, b"")]
            units[absent] = [self.head + zlib.crc32(words[i]) % self.buckets for i in absent.tolist()]
        padded = np.full(total + CONTEXT * len(texts), self.end, np.int32)
        places = np.arange(total) + CONTEXT * np.repeat(np.arange(1, len(texts) + 1), sizes)
        padded[places] = units
        return units, np.stack([padded[places - 1 - j] for j in range(CONTEXT)], axis=1), sizes

    def predict(self, before: np.ndarray) -> np.ndarray:
        seen, place = self.parameters["seen"], self.parameters["place"]
        out = seen[before[:, 0]] * place[0]
        for j in range(1, CONTEXT):
            out += seen[before[:, j]] * place[j]
        return out

    def by_class(self, units: np.ndarray):
        """(class, places) of the units that share a class with others."""
        classes = self.class_of[units]
        shared = np.flatnonzero((self.lows[1:] - self.lows[:-1] > 1)[classes])
        shared = shared[np.argsort(classes[shared], kind="stable")]
        if len(shared):
            cuts = np.flatnonzero(np.diff(classes[shared])) + 1
            for places in np.split(shared, cuts):
                yield int(classes[places[0]]), places

    def log10_classes(self, units: np.ndarray, before: np.ndarray, rows: int = 131_072, step: int = 256) -> np.ndarray:
        """Normalised log10 probabilities of the units, from matrix products over batches of tokens."""
        p, out = self.parameters, np.empty(len(units))
        # scores that cannot leave the range of exp need no shift
        largest = {k: np.sqrt(np.square(p[k]).sum(axis=1).max()) for k in ("class", "word")}

        def choice(h, own, name, first, end):
            scores = h @ p[name][first:end].T
            mine = scores[np.arange(len(scores)), own]
            high = scores.max(axis=1, keepdims=True) if np.sqrt(np.square(h).sum(axis=1).max()) * largest[name] > 60 else None
            if high is not None:
                scores -= high
                mine = mine - high[:, 0]
            np.exp(scores, out=scores)
            return mine - np.log(scores @ np.ones(scores.shape[1], np.float32))

        for low in range(0, len(units), rows):
            part = units[low:low + rows]
            h = np.ones((len(part), WIDTH + 1), np.float32)
            h[:, :WIDTH] = self.predict(before[low:low + rows])
            found, classes = np.empty(len(part)), self.class_of[part]
            for at in range(0, len(part), step):
                found[at:at + step] = choice(h[at:at + step], classes[at:at + step], "class", 0, len(p["class"]))
            for c, places in self.by_class(part):
                first, end = self.lows[c], self.lows[c + 1]
                for at in range(0, len(places), step):
                    some = places[at:at + step]
                    found[some] += choice(h[some], part[some] - first, "word", first, end)
            out[low:low + rows] = found / math.log(10)
        return out

    def train(self, units: np.ndarray, before: np.ndarray, state: dict[str, np.ndarray], rng) -> None:
        """One pass of noise-contrastive steps: the class against NOISE classes, then the unit against NOISE of its class."""
        classes = self.class_of[units]
        log_class_noise, log_noise = np.log(NOISE * self.class_share), np.log(NOISE * self.share)
        for low in range(0, len(units), BATCH):
            noise = np.searchsorted(self.class_below, rng.random(NOISE) * self.class_below[-1], "right")
            self._step("class", classes[low:low + BATCH], np.minimum(noise, len(self.class_below) - 1), log_class_noise,
                       before[low:low + BATCH], state)
        for c, places in self.by_class(units):
            first, end = self.lows[c], self.lows[c + 1]
            for low in range(0, len(places), BATCH):
                some = places[low:low + BATCH]
                drawn = self.below[first] + rng.random(NOISE) * (self.below[end] - self.below[first])
                noise = np.clip(np.searchsorted(self.below, drawn, "right") - 1, first, end - 1)
                self._step("word", units[some], noise, log_noise, before[some], state)

    def _step(self, name: str, true, noise, log_noise, seen_at, state) -> None:
        p = self.parameters
        rows, seen = p[name], p["seen"][seen_at]
        h = np.ones((len(true), WIDTH + 1), np.float32)
        np.einsum("ijk,jk->ik", seen, p["place"], out=h[:, :WIDTH])
        true_rows, noise_rows = rows[true], rows[noise]
        g_true = np.einsum("ij,ij->i", h, true_rows) - log_noise[true]
        g_noise = h @ noise_rows.T - log_noise[noise]
        g_true = 1 / (1 + np.exp(-g_true)) - 1
        g_noise = 1 / (1 + np.exp(-g_noise))
        g_h = (g_true[:, None] * true_rows + g_noise @ noise_rows)[:, :WIDTH]
        self._change(name, np.concatenate((true, noise)), np.concatenate((g_true[:, None] * h, g_noise.T @ h)), len(true), state)
        g_place = np.einsum("ijk,ik->jk", seen, g_h)
        self._change("seen", seen_at.ravel(), (g_h[:, None] * p["place"]).reshape(-1, WIDTH), len(true), state)
        self._change("place", np.arange(CONTEXT), g_place, len(true), state)

    def _change(self, name: str, at, g, n: int, state) -> None:
        """Sums the gradients of equal rows and makes an Adagrad step on these rows."""
        order = np.argsort(at)
        at = at[order]
        starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        g, at = np.add.reduceat(g[order], starts, axis=0), at[starts]
        g /= np.float32(n)
        squares = g * g
        squares += state[name][at]
        state[name][at] = squares
        g *= RATE
        np.sqrt(squares, out=squares)
        squares += LEAST_STEP
        g /= squares
        self.parameters[name][at] -= g
        if (uses := state.get(f"uses_{name}")) is not None:
            uses[at] += np.diff(np.append(starts, len(order)))

    def unpack(self, records) -> Model:
        """The model with the averages of the (name, block, uses, values) records; unused rows stay as they are."""
        out = {k: v.copy() for k, v in self.parameters.items()}
        for name, block, uses, values in records:
            rows = out[name][block * BLOCK:(block + 1) * BLOCK]
            uses = np.frombuffer(uses, np.float32)
            used = uses > 0
            sums = np.frombuffer(values, np.float32).reshape(rows.shape)[used]
            rows[used] = sums / uses[used].reshape(-1, *[1] * (rows.ndim - 1))
        return replace(self, parameters=out)


def head_model(counts: DataFrame, head_words: int = HEAD_WORDS) -> Model:
    """The most frequent words, at most ``head_words``, and the totals of all; ``counts`` is a written table."""
    sizes = counts.groupBy(F.col("word") == F.lit(b""), "c").agg(F.count(F.lit(1)).alias("n")).toDF("is_end", "c", "n").toPandas()
    words = sizes[~sizes["is_end"].astype(bool)].sort_values("c", ascending=False)
    fitting = words[words["n"].cumsum() <= head_words]
    least = int(fitting["c"].min()) if len(fitting) else None
    is_word = F.col("word") != F.lit(b"")
    rows = [] if least is None else counts.where((F.col("c") >= least) & is_word).collect()
    rows = sorted((-r["c"], bytes(r["word"])) for r in rows)
    ends = int(sizes[sizes["is_end"].astype(bool)]["c"].sum())
    buckets = bucket_count(int(words["n"].sum()) - len(rows))
    tail = counts.where(is_word if least is None else (F.col("c") < least) & is_word)
    tail = tail.groupBy((F.crc32("word") % buckets).cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    of_bucket = np.zeros((2, buckets), np.int64)
    of_bucket[:, tail["b"].to_numpy(np.int64)] = tail[["c", "n"]].to_numpy(np.int64).T
    return Model({w: i for i, (_, w) in enumerate(rows)}, np.array([-c for c, _ in rows], np.int64),
                 int((sizes["c"] * sizes["n"]).sum()), int(sizes["n"].sum()), ends, *of_bucket)


def shard_count(tokens: int) -> int:
    """Shards that so many training tokens are dealt to; a shard grows as their root does."""
    return 1 + math.isqrt(tokens >> 20)


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(whole_text, times, shard): each shard together, with the same rows in the same order whatever the files of ``docs``.

    Equal rows are counted first and their number is spread over the shards.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("whole_text"))
    rows = rows.groupBy("doc_id", "whole_text").agg(F.count(F.lit(1)).alias("n"))
    copies = rows.select(
        "*", F.xxhash64("doc_id", "whole_text").alias("place"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(shards)) - 1)).alias("copy"))
    # equal rows go to one shard after another, so that each gets its part of them
    copies = copies.withColumn("shard", F.pmod(F.pmod("place", F.lit(shards)) + F.col("copy"), F.lit(shards)).cast("int"))
    ordered = copies.repartition(4 * shards, "shard").sortWithinPartitions("shard", "place", "copy", "doc_id", "whole_text")
    return ordered.select("whole_text", F.expr(f"(n - copy + {shards - 1}) div {shards}").alias("times"), "shard")


def train_model(docs: DataFrame, model: Model) -> Model:
    """Each shard's texts are passed over once, in one task; each row of parameters is averaged, weighted by its uses.

    Shards depend on the rows alone, so the model is the same on any cluster and for any files.
    """
    context = docs.sparkSession.sparkContext
    shared, shards = context.broadcast(model), shard_count(model.tokens)

    def packed(values: np.ndarray) -> bytes:
        return values.astype(np.float32).tobytes()

    def parts(batches):
        """(shard, texts, times) of runs of rows of one shard."""
        for batch in batches:
            of = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                for start, texts in slices(batch.column(0).slice(low, high - low)):
                    yield int(of[low]), texts, batch.column(1).slice(low + start, len(texts)).to_pylist()

    def run(batches):
        for shard, rows in groupby(parts(batches), key=itemgetter(0)):
            mine = replace(shared.value, parameters={k: v.copy() for k, v in shared.value.parameters.items()})
            state = {k: np.zeros_like(v) for k, v in mine.parameters.items()}
            state |= {f"uses_{k}": np.zeros(len(v)) for k, v in mine.parameters.items()}
            rng = np.random.default_rng(shard)
            for _, texts, times in rows:
                for turn in range(max(times)):
                    units, before, _ = mine.sequences([t.lower().split() for t, n in zip(texts, times, strict=True) if n > turn])
                    mine.train(units, before, state, rng)
            yield from records_of(mine, state, shard)

    def records_of(mine, state, shard):
        for name, values in mine.parameters.items():
            found = []
            for block in range(0, len(values), BLOCK):
                uses, part = state[f"uses_{name}"][block:block + BLOCK], values[block:block + BLOCK]
                if uses.any():
                    found.append((name, block // BLOCK, shard, *map(packed, (uses, (part.T * uses).T))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (
                    pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    names=["name", "block", "shard", "uses", "sums"])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")  # sums of floats depend on their order
        uses, sums = (sum(np.frombuffer(v.as_py(), np.float32).astype(float) for v in group.column(c)) for c in (3, 4))
        first = [group.column(c)[:1] for c in range(3)]
        return pa.table([*first, [packed(uses)], [packed(sums)]], schema=group.schema)

    schema = "name string, block int, shard int, uses binary, sums binary"
    # a group holds a record of 18 KB of each shard, whose number grows as the root of the tokens
    records = dealt(docs, shards).mapInArrow(run, schema).groupBy("name", "block").applyInArrow(add, schema)
    return model.unpack(records.select("name", "block", "uses", "sums").collect())


def score_texts(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = rows.where("not held_out")
    counts = written(word_counts(training), "word-counts")
    model = train_model(training, head_model(counts, head_words))
    shared = spark.sparkContext.broadcast(model)

    def make():
        m = shared.value
        # of a unit alone; what the word of a bucket adds to it comes from the join
        unit_base = np.concatenate((m.base(m.counts), np.zeros(m.buckets), [m.base(m.ends)]))
        unit_share = np.concatenate((np.zeros(m.head), -np.log10(m.bucket_mass), [0.0]))

        def run(texts: list[bytes]) -> list:
            words = [t.lower().split() for t in texts]
            units, before, sizes = m.sequences(words)
            log10 = m.log10_classes(units, before) + unit_share[units]
            ends = np.cumsum(sizes)
            known, is_end = units < m.head, units == m.end
            base = unit_base[units]
            starts = ends - sizes
            tails = []
            for text, low in zip(words, starts.tolist(), strict=True):
                absent = np.flatnonzero(units[low:low + len(text)] >= m.head)
                tails.append([{"word": w, "n": n} for w, n in Counter(text[i] for i in absent.tolist()).items()])
            n_known = np.add.reduceat((known | (is_end & (m.ends > 0))).astype(np.int64), starts)
            return [sizes.tolist(), n_known.tolist(), np.add.reduceat(base, starts).tolist(),
                    np.add.reduceat(log10, starts).tolist(), tails]

        return run

    fields = "n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, n: long>>"
    scored = per_text(rows, make, fields, ("doc_id", "held_out")).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    unit = math.log10(model.tokens + 0.5 * (model.types + 1))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    found = tail.join(counts, "word", "left").select(
        "row", "n", F.coalesce("c", F.lit(0)).alias("c")).groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("logs"), F.sum("n").alias("tails"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    none = F.lit(0.0)
    tails, logs = F.coalesce("tails", F.lit(0)), F.coalesce("logs", none)
    return scored.drop("tail").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs - tails * unit).alias("base_score"),
        (F.col("score") + logs).alias("score"))
