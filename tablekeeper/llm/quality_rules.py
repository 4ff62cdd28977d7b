"""Quality rules: an isolation forest on rule statistics.

Each document's rule statistics are counted over its whole text.  Documents
that break a base rule fail outright.  The others are judged by an isolation
forest: trees split a random statistic at a random value, and documents that
are isolated after few splits are anomalous.  The forest is grown from about
``FIT_ROWS`` labelled documents that pass the base rules (a share of them by the
hash of their ids, at most half; ``TREE_ROWS`` for each tree), of which
``BAD_SHARE`` are labelled bad: few enough to be isolated, and there at all, as
a statistic that never varies among good documents could not be split.

The threshold is calibrated on the labelled documents that the forest has not
seen, of both classes: from a histogram of their scores, the one of the largest
recall less ``COST`` times the share of good ones that go, of which there may be
``FALSE_REJECTIONS`` at most.  Without any bad label among them it is the
``KEEP`` quantile of the good ones.

Nulls and odd rows: a null text has no words and fails; a null doc_id stays
null and has no label; of several labels of a document the lowest quality
counts; null labels are none; without any good label only the base rules
decide.  Repeated rows come out once each; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.llm.blocks import Block, ids_out, iter_blocks, mix, run_hash
from tablekeeper.session import materialize

REPEAT_WINDOW = 8
FIT_ROWS = 8192
TREES, TREE_ROWS = 200, 256
BAD_SHARE = 0.02
KEEP, FALSE_REJECTIONS, COST = 0.998, 0.01, 5
CELLS = 2000        # of the histogram of scores
#: fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 20, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct",
          "n_digits", "n_upper", "n_longest"]
_CLASSES = {"n_symbols": SYMBOLS, "n_digits": b"0123456789", "n_upper": bytes(range(65, 91))}


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, np.bool_)
    t[list(members)] = True
    return t


def _line_counts(block: Block, w) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per document, and those equal to an earlier line of it."""
    with_word = np.zeros(block.body.size + 1, np.int64)
    with_word[w.start] = 1
    words_before = np.cumsum(with_word) - with_word
    raw = block.body.tobytes()
    ends = np.flatnonzero(block.body == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(block.end, starts, side="left")
    real = words_before[ends] > words_before[starts]
    lines = np.bincount(doc[real], minlength=block.ids.size)
    dup, seen, last = np.zeros(block.ids.size, np.int64), set(), -1
    for a, b, d in zip(starts[real].tolist(), ends[real].tolist(), doc[real].tolist()):
        if d != last:
            seen, last = set(), d
        line = raw[a:b]
        if line in seen:
            dup[d] += 1
        else:
            seen.add(line)
    return lines, dup


def block_counts(block: Block) -> dict[str, np.ndarray]:
    """The rule statistics of a block's documents."""
    w, n_docs = block.words(), block.ids.size
    n = block.count(w)
    chars = np.concatenate([[0], np.cumsum((block.body & 0xC0) != 0x80)])
    word_chars = chars[w.start + w.length] - chars[w.start]
    by_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n_docs).astype(np.int64)
    out = {"n_words": n, "word_chars": by_doc(word_chars), "n_chars": chars[block.end] - chars[block.start]}
    for name, members in _CLASSES.items():
        c = np.concatenate([[0], np.cumsum(_table(members)[block.body])])
        out[name] = c[block.end] - c[block.start]
    out["n_lines"], out["n_dup_lines"] = _line_counts(block, w)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, w.doc, word_chars)
    out["n_longest"] = longest
    salt = mix(np.arange(n_docs, dtype=np.uint64))
    _, first = np.unique(w.hash ^ salt[w.doc], return_index=True)
    out["n_distinct"] = np.bincount(w.doc[first], minlength=n_docs)
    at = w.whole_windows(REPEAT_WINDOW)
    _, which, times = np.unique(run_hash(w.hash, REPEAT_WINDOW)[at] ^ salt[w.doc[at]] if at.size else np.empty(0, np.uint64),
                                return_inverse=True, return_counts=True)
    again = at[times[which] > 1] if at.size else at
    edge = np.zeros(w.start.size + 1, np.int64)
    edge[again] += 1
    edge[again + REPEAT_WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)
    return out


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of ``COUNTS`` per document."""
    def run(batches):
        for block in iter_blocks(batches):
            c = block_counts(block)
            yield pa.RecordBatch.from_arrays([ids_out(block.ids), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)],
                                             ["doc_id", *COUNTS])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rates per document; the forest splits these."""
    c = {k: v.astype(np.float64) for k, v in c.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
                     c["n_repeat_words"] / words, c["n_digits"] / chars, c["n_upper"] / words,
                     np.log(words / lines), np.log(np.maximum(c["n_distinct"], 1)) / np.log(words + 1),
                     c["n_longest"] / (5 + np.log2(words + 1)), c["word_chars"] / chars], axis=1)


class Forest:
    """Isolation forest as flat arrays: statistic, value, children; leaves hold their path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.norm = self._unsuccessful(min(rows, len(x)))
        self.roots, self.col, self.cut, self.left, self.right, self.depth = [], [], [], [], [], []
        limit = int(np.ceil(np.log2(max(2, rows)))) + 2
        for _ in range(trees):
            self.roots.append(self._grow(rng, x[rng.choice(len(x), min(rows, len(x)), replace=False)], 0, limit))
        for k in ("roots", "col", "cut", "left", "right", "depth"):
            setattr(self, k, np.array(getattr(self, k)))

    @staticmethod
    def _unsuccessful(n: int) -> float:
        """Mean path length of a random search tree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, rng, x: np.ndarray, at: int, limit: int) -> int:
        i = len(self.col)
        for k, v in (("col", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("depth", at + self._unsuccessful(len(x)))):
            getattr(self, k).append(v)
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if at < limit and len(spread):
            c = int(rng.choice(spread))
            v = float(rng.uniform(x[:, c].min(), x[:, c].max()))
            self.col[i], self.cut[i] = c, v
            self.left[i] = self._grow(rng, x[x[:, c] <= v], at + 1, limit)
            self.right[i] = self._grow(rng, x[x[:, c] > v], at + 1, limit)
        return i

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; more is more anomalous."""
        total = np.zeros(len(x))
        for root in self.roots:
            at, todo = np.full(len(x), root), np.arange(len(x))
            while todo.size:
                todo = todo[self.col[at[todo]] >= 0]
                a = at[todo]
                at[todo] = np.where(x[todo, self.col[a]] <= self.cut[a], self.left[a], self.right[a])
            total += self.depth[at]
        return 2.0 ** -(total / len(self.roots) / max(self.norm, 1e-9))


def best_threshold(cells: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """The score above which documents go, from counts by cell of the score."""
    rejected = lambda n: (n.sum() - np.cumsum(n)) / max(1, n.sum())  # noqa: E731   share above each cell
    edges, good_lost = (cells + 1) / CELLS, rejected(good)
    if not bad.sum():
        return float(edges[np.flatnonzero(good_lost <= 1 - keep)[0]])
    worth = np.where(good_lost <= FALSE_REJECTIONS, rejected(bad) - COST * good_lost, -1.0)
    return float(edges[int(np.argmax(worth))])


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """Per document its statistics, base_failed, the forest's score and kept."""
    spark = docs.sparkSession
    stats = materialize(rule_statistics(docs), "rule-statistics")
    told = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg((F.min("quality") > 0).alias("good")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    labelled = materialize(stats.where(~base).join(told, "doc_id"), "labelled-statistics")
    n = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    share = min(0.5, fit_rows / max(1, n.get(True, 0)))
    bad_share = min(0.5, BAD_SHARE * share * n.get(True, 0) / max(1, n.get(False, 0)))
    at = F.expr(f"pmod(xxhash64(doc_id), {1 << 31}L) / {float(1 << 31)}D")
    drawn = at < F.when(F.col("good"), share).otherwise(bad_share)
    sample = labelled.where(drawn).limit(2 * fit_rows).toPandas().sort_values(["doc_id", *COUNTS])   # about FIT_ROWS rows reach the driver
    if not sample["good"].any():
        return stats.select("*", base.alias("base_failed"), F.lit(None).cast("double").alias("score"), (~base).alias("kept"))
    forest = spark.sparkContext.broadcast(Forest(features({k: sample[k].to_numpy() for k in COUNTS})))

    def run(batches):
        for b in batches:
            x = features({k: b.column(k).to_numpy() for k in COUNTS})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.value.score(x))], [*b.schema.names, "score"])

    columns = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    cell = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1)).alias("cell")
    counts = (labelled.where(~drawn).mapInArrow(run, columns + ", good boolean, score double").groupBy(cell)
              .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("cell").toPandas())   # CELLS rows at most
    if not counts["good"].sum():
        return stats.select("*", base.alias("base_failed"), F.lit(None).cast("double").alias("score"), (~base).alias("kept"))
    limit = best_threshold(*[counts[c].to_numpy() for c in ("cell", "good", "bad")], keep)
    return (stats.mapInArrow(run, columns + ", score double").select("*", base.alias("base_failed"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(limit))))
