"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of a document's words in lower case (A-Z), one space
after each; all words count, and each digit is read as 0, as which number it is
says nothing about prose.  For each language, n-grams of up to
``ORDER`` symbols are counted over all documents labelled trusted (quality 1,
not toxic), but for one in ``HELD_OUT``, which calibrate.  A second model of the
same kind is counted over the documents labelled toxic, for contrast: a
misspelling surprises both models, what only toxic text says surprises one.

1. Each block lists its distinct n-grams of full order, with their counts in
   its trusted and toxic documents, and deals them into parts by language and
   the two symbols before the last.  All orders from 3 up of an n-gram meet in its part.
2. Each part merges the counts and tells counts of counts and, for the two
   lowest orders (at most 65,536 pairs a language), continuation counts.  From
   those come the three discounts of each order.
3. Each part joins the blocks' n-grams with the merged counts and sends the log
   probabilities back to the blocks.
4. A block adds them up: a document's perplexity under trusted text, and its
   peak, the ``REACH`` symbols in a row that gain most in log probability from
   trusted to toxic text, which a few words raise and a mean would hide.  The
   peak is compared with what a text of its length may reach: each doubling of
   the length allows ``slope`` more, as fitted on the held-out documents.

A document is rejected if its perplexity or its peak is over the ``KEEP``
quantile of its language's held-out trusted documents (of all, for a language
with fewer than ``ENOUGH`` of them).

Nulls and odd rows: a null or empty text has no symbols, perplexity null, and
is kept; a null lang is a language of its own; of several labels of a document
the worst counts; a null doc_id has no label; without trusted text nothing is
rejected; without toxic text the peak is that of surprise alone.  Repeated rows come out once each; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.llm.blocks import (SPACES, Block, each_block, expand, ids_out, if_few, kept_bytes, mix, planes, squeeze,
                                    unplanes, write_blocks)
from tablekeeper.session import materialize

ORDER, REACH = 5, 4
TRAIN, HELD, TOXIC = 0, 1, 2
HELD_OUT, ENOUGH = 5, 50
KEEP = 0.999
BLOCK_BYTES = 8 << 20
_SLICE = 2 << 20
#: fixed values: all digits are one symbol
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[list(b"0123456789")] = ord("0")
_BODY = np.uint64((1 << 40) - 1)
_U = np.uint64


class Symbols:
    """The n-grams of a block, document by document: language code, buffer, and where each document's symbols lie.

    The first line of each text is its language.
    """

    def __init__(self, block: Block):
        w = block.words(SPACES, lower=True)
        newline = np.flatnonzero(block.body == 10)
        line = newline[np.searchsorted(newline, block.start)]       # the end of each document's first line
        keep = w.start > line[w.doc]
        lowered = Block(block.ids, block.start, block.end, _SYMBOL[w.body])
        self.buffer, self.start, end = kept_bytes(lowered, w, keep)
        self.end = np.append(self.start[1:], self.buffer.size)      # with the space after the last word
        raw = block.body.tobytes()
        self.names = [raw[a:b] for a, b in zip(block.start.tolist(), line.tolist())]
        self.lang = np.array([zlib.crc32(x) & 0xFFFF for x in self.names], _U)

    def slices(self):
        """(first document, last, keys of the n-grams, document of each); a key is 16 bits of language and ORDER symbols."""
        a = 0
        while a < self.lang.size:
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _SLICE, "right")))
            at, to = int(self.start[a]), int(self.end[b - 1])
            x = self.buffer[at:to].astype(_U)
            m = x.size - ORDER + 1
            if m > 0:
                key = x[:m].copy()
                for j in range(1, ORDER):
                    key <<= _U(8)
                    key |= x[j: j + m]
                doc = np.repeat(np.arange(a, b), self.end[a:b] - self.start[a:b])
                one = doc[:m] == doc[ORDER - 1:]
                doc = doc[:m][one]
                yield a, b, key[one] | (self.lang[doc] << _U(40)), doc
            else:
                yield a, b, np.empty(0, _U), np.empty(0, np.int64)
            a = b


def _distinct(symbols: Symbols, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct keys in order, and their counts in trusted and in toxic documents."""
    rows = []
    for _, _, key, doc in symbols.slices():
        if key.size:
            order = np.argsort(key)
            key, of = key[order], role[doc[order]]
            start = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            rows.append((key[start], *(np.add.reduceat(of == r, start, dtype=np.int64) for r in (TRAIN, TOXIC))))
    return _merge(rows)


def _merge(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts in both models, of lists of keys with counts."""
    if not rows:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    key, *counts = map(np.concatenate, zip(*rows))
    all_, which = np.unique(key, return_inverse=True)
    return all_, *(np.bincount(which, weights=c, minlength=all_.size).astype(np.int64) for c in counts)


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys by part, and their parts: by language and the two symbols before the last."""
    near = (keys >> _U(8) & _U(0xFFFF)) | (keys >> _U(40) << _U(16))
    part = (mix(near) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], part.size]))


def _unpack(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = expand(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(unplanes(raw, "<u8", n, 4)), *(unplanes(raw, "<u4", n, 4 + a * n).astype(np.int64) for a in (8, 12))


def _level(keys: np.ndarray, counts: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Continuation counts of the last ``symbols`` symbols: of how many seen longer n-grams they are the end."""
    lang = ~_BODY
    low = keys & (lang | _U((1 << 8 * symbols) - 1))
    return np.unique(low[counts > 0], return_counts=True)


def _counts_of_counts(key, table):
    merged, *both = _merge([_unpack(x.as_buffer()) for x in table.column("grams")])
    out = []
    for model, counts in enumerate(both):
        keys, counts = merged[counts > 0], counts[counts > 0]
        for order in range(ORDER, 2, -1):
            lang = (keys >> _U(40)).astype(np.int64)
            for j in (1, 2, 3, 4):
                who, n = np.unique(lang[counts == j], return_counts=True)
                out += [(model, a, order, j, c) for a, c in zip(who.tolist(), n.tolist())]
            keys, counts = _level(keys, counts, order - 1)
        # what the part adds to each pair's continuation count
        out += [(model, k >> 40, 2, k & 0xFFFF, c) for k, c in zip(keys.tolist(), counts.tolist())]
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 5)], ["m", "lang", "n", "g", "c"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts; where too few are counted, half of each count."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k) for k, d in ((1.0, 1 - 2 * y * n2 / n1), (2.0, 2 - 3 * y * n3 / n2), (3.0, 3 - 4 * y * n4 / n3)))


class Base:
    """What all parts need: discounts by (language, order), and probabilities of pairs by language."""

    def __init__(self, rows):
        self.d: dict[tuple[int, int], tuple] = {}
        self.pair: dict[int, np.ndarray] = {}
        cc: dict[tuple[int, int], list] = {}
        pairs: dict[int, np.ndarray] = {}
        for lang, order, g, c in rows:
            if order == 2:
                pairs.setdefault(lang, np.zeros((256, 256)))[g >> 8, g & 255] = c
            else:
                cc.setdefault((lang, order), [0, 0, 0, 0])[g - 1] = c
        for lang, c2 in pairs.items():
            c1 = (c2 > 0).sum(0).astype(float)
            one = self._mixed(c1[None, :], np.full((1, 256), 1 / 256))
            self.pair[lang] = self._mixed(c2, np.broadcast_to(one, c2.shape)).astype(np.float32)
            for order in range(3, ORDER + 1):
                self.d[lang, order] = discounts(*cc.get((lang, order), [0] * 4))

    @staticmethod
    def _mixed(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = discounts(*((c == j).sum() for j in (1, 2, 3, 4)))
        total = c.sum(1, keepdims=True)
        less = np.select([c == 1, c == 2, c >= 3], d, 0.0)
        return np.where(total > 0, (c - less) / np.maximum(total, 1) + less.sum(1, keepdims=True) / np.maximum(total, 1) * lower, lower)

    def score(self, ask: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probabilities of the last symbols of n-grams (sorted), given the part's merged counts."""
        lang = (ask >> _U(40)).astype(np.int64)
        p = np.full(ask.size, 1 / 256)
        for code in np.unique(lang).tolist():
            if code in self.pair:
                own = lang == code
                p[own] = self.pair[code][(ask[own] >> _U(8) & _U(255)).astype(np.intp), (ask[own] & _U(255)).astype(np.intp)]
        levels = [(keys[counts > 0], counts[counts > 0])]
        for order in range(ORDER - 1, 2, -1):
            levels.append(_level(*levels[-1], order))
        for order, (g, c) in zip(range(3, ORDER + 1), levels[::-1]):
            if not g.size:
                continue
            glang = (g >> _U(40)).astype(np.int64)
            less = np.zeros(g.size)
            for code in np.unique(glang).tolist():
                d = self.d.get((code, order), (0.5, 1.0, 1.5))
                own = glang == code
                less[own] = np.select([c[own] == 1, c[own] == 2], d[:2], d[2])
            ctx, which = np.unique(g >> _U(8), return_inverse=True)
            total, back = np.bincount(which, weights=c), np.bincount(which, weights=less)
            q = ask & (~_BODY | _U((1 << 8 * order) - 1))
            at = np.minimum(np.searchsorted(ctx, q >> _U(8)), ctx.size - 1)
            known = ctx[at] == q >> _U(8)
            hit = np.minimum(np.searchsorted(g, q), g.size - 1)
            top = np.where(g[hit] == q, c[hit] - less[hit], 0.0)
            p = np.where(known, top / total[at] + back[at] / total[at] * p, p)
        return np.log(p)


SCORES = "doc_id long, lang string, symbols long, log_p double, peak double, role int"


def scores(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: symbols scored, the sum of their log probabilities, the peak, and its role (TRAIN, HELD, TOXIC, null)."""
    spark = docs.sparkSession
    blocks = write_blocks(docs.select("doc_id", F.concat(F.regexp_replace(F.coalesce(F.col("lang").cast("string"), F.lit("")), r"\s", ""),
                                                         F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")),
                          None, block_bytes).drop("note")
    trusted = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
               .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
               .select("doc_id", F.when(F.col("t") > 0, TOXIC).when(F.col("q") <= 0, None)
                       .when(F.expr(f"pmod(xxhash64(doc_id), {HELD_OUT}) = 0"), HELD).otherwise(TRAIN).alias("role"))
               .where("role IS NOT NULL"))
    marks = materialize(blocks.select("block", F.posexplode("doc_id").alias("i", "doc_id")).join(trusted, "doc_id")
                        .groupBy("block").agg(F.collect_list(F.struct("i", "role")).alias("marks")), "labelled-documents")
    marked = blocks.join(marks, "block", "left")
    n_blocks = blocks.select("block").count()
    parts = max(1, n_blocks * block_bytes // (32 << 20))

    def roles(batch, i, n: int) -> np.ndarray:
        out = np.full(n, -1, np.int64)
        for m in batch.column("marks")[i].as_py() or []:
            out[m["i"]] = m["role"]
        return out

    def send(batches):
        for batch, i, number, block in each_block(batches):
            keys, *counts = _distinct(Symbols(block), roles(batch, i, block.ids.size))
            order, part = _by_part(keys, parts)
            keys, (good, bad) = keys[order], (c[order].astype("<u4") for c in counts)
            if keys.size:
                cuts = _cuts(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a]) for a, _ in cuts]), pa.array([number] * len(cuts)), pa.array([squeeze(
                        np.array([b - a], "<u4").tobytes() + planes(np.diff(keys[a:b], prepend=_U(0)))
                        + planes(good[a:b]) + planes(bad[a:b]))
                        for a, b in cuts], pa.binary())], ["part", "block", "grams"])

    grams = materialize(marked.mapInArrow(send, "part long, block long, grams binary"), "n-grams")
    told = (grams.select("part", "grams").groupBy("part").applyInArrow(_counts_of_counts, "m long, lang long, n long, g long, c long")
            .groupBy("m", "lang", "n", "g").agg(F.sum("c").alias("c")).collect())   # at most 65,536 + 12 rows a language and model
    base = spark.sparkContext.broadcast([Base([tuple(r)[1:] for r in told if r["m"] == m]) for m in (0, 1)])

    def join(key, table):
        each = [_unpack(x.as_buffer()) for x in table.column("grams")]
        keys, *counts = _merge(each)
        log_p, gain = (b.score(keys, keys, c).astype("<f2") for b, c in zip(base.value, counts))
        at = [np.searchsorted(keys, k) for k, _, _ in each]
        return pa.table({"block": table.column("block"), "part": pa.array([key[0].as_py()] * len(each), pa.int64()),
                         "log_p": pa.array([squeeze(planes(log_p[x]) + planes(gain[x])) for x in at], pa.binary())})

    answers = (grams.groupBy("part").applyInArrow(join, "block long, part long, log_p binary")
               .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "log_p"))).alias("answers")))

    def add_up(batches):
        for batch, i, _, block in each_block(batches):
            s = Symbols(block)
            role = roles(batch, i, block.ids.size)
            keys, _, _ = _distinct(s, role)
            order, part = _by_part(keys, parts)
            log_p, gain = np.empty(keys.size), np.empty(keys.size)
            for (a, b), x in zip(_cuts(part), batch.column("answers")[i].as_py() or [], strict=True):
                raw = expand(x["log_p"])
                log_p[order[a:b]], gain[order[a:b]] = unplanes(raw, "<f2", b - a), unplanes(raw, "<f2", b - a, 2 * (b - a))
            gain -= log_p
            n, total, peak = np.zeros(role.size, np.int64), np.zeros(role.size), np.full(role.size, -np.inf)
            for _, _, key, doc in s.slices():
                if not key.size:
                    continue
                at = np.searchsorted(keys, key)
                lp = log_p[at]
                n += np.bincount(doc, minlength=role.size)
                total += np.bincount(doc, weights=lp, minlength=role.size)
                run = np.cumsum(np.concatenate([[0.0], gain[at]]))
                run = run[REACH:] - run[:-REACH]
                one = doc[: run.size] == doc[REACH - 1:][: run.size]
                np.maximum.at(peak, doc[: run.size][one], run[one])
            names = [x.decode("utf-8", "replace") for x in s.names]
            yield pa.RecordBatch.from_arrays(
                [ids_out(block.ids), pa.array(names), pa.array(n), pa.array(total), pa.array(peak, mask=np.isinf(peak)),
                 pa.array(role, pa.int32(), mask=role < 0)], ["doc_id", "lang", "symbols", "log_p", "peak", "role"])

    return marked.join(answers, "block", "left").mapInArrow(add_up, SCORES)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per document: lang, symbols, perplexity, peak (for its length), role and kept."""
    scored = materialize(scores(docs, labels), "perplexities")
    size = F.log2(F.greatest(F.col("symbols"), F.lit(16)))
    held = scored.where(f"role = {HELD} AND symbols > 0")
    fit = held.agg(F.regr_slope("peak", size).alias("b")).first()
    slope = max(0.0, float(fit["b"] or 0.0))
    stat = scored.select("doc_id", "lang", "symbols", "role", F.when(F.col("symbols") > 0, F.exp(-F.col("log_p") / F.col("symbols"))).alias("perplexity"),
                         (F.col("peak") - slope * size).alias("peak"))
    quantile = lambda c: F.percentile_approx(c, F.lit(keep), F.lit(100_000))
    held = stat.where(f"role = {HELD} AND symbols > 0")
    own = (held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), quantile("perplexity").alias("p_at"), quantile("peak").alias("k_at"))
           .where(f"n >= {ENOUGH}").drop("n"))
    every = held.agg(quantile("perplexity").alias("p"), quantile("peak").alias("k")).first()
    limit = lambda c, v: F.coalesce(F.col(c), F.lit(v).cast("double"), F.lit(float("inf")))
    over = (F.col("perplexity") > limit("p_at", every["p"])) | (F.col("peak") > limit("k_at", every["k"]))
    return (stat.join(own, "lang", "left").withColumn("kept", ~F.coalesce(over, F.lit(False)))
            .select("doc_id", "lang", "symbols", "perplexity", "peak", "role", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; rows of one doc_id go if one of them is rejected."""
    bad = if_few(classify(docs, labels, keep).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "rejected")
    return docs.join(bad, "doc_id", "left_anti")
