"""Language-model scores: marginal probability of a text over all segmentations into subwords.

A text is a sequence of words and an end. A word, led by the vocabulary's blank mark, is cut into pieces of an
existing vocabulary in any way; pieces are independent, so the probability of a word is the sum over all paths of its
lattice of the product of the piece probabilities (forward recursion in log space), and that of a text is the product
over its words and the end. A character that no piece spells goes by its UTF-8 byte pieces.

The vocabulary's own scores give the first piece probabilities: a score that is a rank r (merge order) counts as
1 / (r + ``RANK_OFFSET``). Expected piece counts over the lattices of the training words, ``ROUNDS`` times, replace them,
the vocabulary's probabilities staying as ``PRIOR`` pseudo-counts.

Beside it the base model: add-0.1 word counts of the training documents. Word counts, probabilities and sums cover all
documents. A document's words meet the word table by (bucket, word): buckets hold about ``BUCKET_BYTES`` of text, each
sends a word once, and gets back its count and probability.

Cases: a null or blank text is the end alone; no training document: all counts are 0; a null doc_id is in training and
not held out; repeated rows count each time; an empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import buckets, crc_mod, map_arrow, stage
from flowlens.llm.letters import rolling

BUCKET_BYTES = 16_000_000
ROUNDS = 2
PRIOR = 100.0
RANK_OFFSET = 10.0
SLOTS = 22


class Vocabulary:
    """Pieces by the hash of their code points."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.size, self.end = size, sp.eos_id()
        self.bytes = np.zeros(256, np.int64)
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.prior = np.zeros(size)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
                self.prior[i] = 1e-7
            elif i == self.end:
                self.prior[i] = 1e-3
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = np.array([ord(c) for c in sp.id_to_piece(i)], np.uint32)
                groups.setdefault(len(p), []).append((int(rolling(p, len(p))[0]), i))
                self.prior[i] = np.exp(scores[i]) if scores.max() <= 0 and scores.min() > -100 else 1 / (RANK_OFFSET + max(0.0, -scores[i]))
        self.prior /= self.prior.sum()
        self.lengths = sorted(groups)
        self.keys, self.ids, self.seen = {}, {}, {}
        for n, found in groups.items():
            found.sort()
            self.keys[n] = np.array([h for h, _ in found], np.uint64)
            self.ids[n] = np.array([i for _, i in found], np.int64)
            self.seen[n] = np.zeros(1 << SLOTS, bool)
            self.seen[n][self.keys[n] >> np.uint64(64 - SLOTS)] = True


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """All edges of the lattices of a batch of words: (from node, to node, pieces); nodes are global character ends."""

    def __init__(self, v: Vocabulary, words: list[str]):
        marked = ["▁" + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = lengths
        ends = np.cumsum(lengths)
        begin = ends - lengths
        left = np.repeat(ends, lengths) - np.arange(len(cp))  # characters from here to the end of the word
        at, piece, span = [], [], []
        for n in v.lengths:
            h = rolling(cp, n)
            ok = np.flatnonzero(v.seen[n][h >> np.uint64(64 - SLOTS)] & (left[:len(h)] >= n)) if len(h) else np.zeros(0, np.int64)
            k = np.minimum(np.searchsorted(v.keys[n], h[ok]), len(v.keys[n]) - 1)
            real = v.keys[n][k] == h[ok]
            at.append(ok[real])
            piece.append(v.ids[n][k[real]])
            span.append(np.full(int(real.sum()), n))
        at, self.piece, span = map(np.concatenate, (at, piece, span))
        # characters without a piece of their own: one edge with their byte pieces
        alone = np.ones(len(cp), bool)
        alone[at[span == 1]] = False
        lost = np.flatnonzero(alone)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in cp[lost]]
        self.byte_piece = v.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.byte_edge = np.repeat(np.arange(len(lost)) + len(at), sizes)
        self.source = np.concatenate([at, lost])
        self.target = np.concatenate([at + span, lost + 1])
        self.begin, self.ends = begin, ends
        # edges by the number of characters before their end, the order of the recursion
        self.word = np.repeat(np.arange(len(words)), lengths)
        depth = self.target - begin[self.word[self.source]]
        self.order = np.argsort(depth, kind="stable")
        self.cuts = np.searchsorted(depth[self.order], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))

    def weights(self, logp: np.ndarray) -> np.ndarray:
        spelled = np.bincount(self.byte_edge, logp[self.byte_piece], minlength=len(self.source))[len(self.piece):]
        return np.concatenate([logp[self.piece], spelled])

    def _sweep(self, w, source, target, order, cuts, first, size):
        total = np.full(size, -np.inf)
        total[first] = 0.0
        for a, b in zip(cuts, cuts[1:]):
            e = order[a:b]
            if not len(e):
                continue
            x = total[source[e]] + w[e]
            t = target[e]
            s = np.argsort(t, kind="stable")
            x, t = x[s], t[s]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            top = np.maximum.reduceat(x, head)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                total[t[head]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.concatenate([head, [len(x)]])))), head))
        return total

    def nodes(self):
        """Node numbers: a word of n characters has n + 1 nodes."""
        shift = np.arange(len(self.n))
        source = self.source + shift[self.word[self.source]]
        target = self.target + shift[self.word[self.source]]
        return source, target, self.begin + shift, self.ends + shift, int(self.n.sum()) + len(self.n)

    def forward(self, logp: np.ndarray):
        w = self.weights(logp)
        source, target, first, last, size = self.nodes()
        alpha = self._sweep(w, source, target, self.order, self.cuts, first, size)
        return alpha[last], (w, source, target, first, last, size, alpha)

    def expected(self, logp: np.ndarray, counts: np.ndarray, pieces: int) -> np.ndarray:
        """Expected piece counts over the lattices, weighted by the words' counts."""
        logz, (w, source, target, first, last, size, alpha) = self.forward(logp)
        depth = self.ends[self.word[self.source]] - self.source  # characters from the edge's start to the end
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        beta = self._sweep(w, target, source, order, cuts, last, size)
        word = self.word[self.source]
        use = np.exp(alpha[source] + w + beta[target] - logz[word]) * counts[word]
        out = np.bincount(self.piece, use[:len(self.piece)], minlength=pieces)
        return out + np.bincount(self.byte_piece, use[self.byte_edge], minlength=pieces)


def _chunks(words: list[str], chars: int = 300_000):
    lo, n = 0, 0
    for i, w in enumerate(words):
        if n and n + len(w) > chars:
            yield lo, i
            lo, n = i, 0
        n += len(w) + 1
    if lo < len(words):
        yield lo, len(words)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (A-Z lower-cased, split at the six ASCII spaces) and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    return words.filter(real), owner.filter(real).to_numpy()


def _large(batch: pa.RecordBatch | pa.Table):
    return batch.column("text").cast(pa.large_string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of ``docs`` (text, train) and its count in the training rows."""
    def run(b):
        for train in (True, False):
            flag = b.column("train") if train else pc.invert(b.column("train"))
            words, _ = tokens(_large(b).filter(flag))
            if len(words):
                found = pc.value_counts(words)
                c = found.field("counts").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), c if train else pc.multiply(c, 0)], names=["word", "c"])
    return map_arrow(docs.select("text", "train"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(counts: DataFrame, documents: int, path: str) -> np.ndarray:
    """Log piece probabilities after ``ROUNDS`` rounds of expected counts over the training words."""
    v = vocabulary(path)
    sc = counts.sparkSession.sparkContext
    p = v.prior
    for _ in range(ROUNDS):
        logp = sc.broadcast(np.log(np.maximum(p, 1e-300)))

        def run(batches, logp=logp):
            v, total = vocabulary(path), None
            for b in batches:
                words, c = b.column("word").to_pylist(), b.column("c").to_numpy().astype(float)
                order = sorted(range(len(words)), key=lambda i: len(words[i]))
                words, c = [words[i] for i in order], c[order]
                for lo, hi in _chunks(words):
                    got = Lattices(v, words[lo:hi]).expected(logp.value, c[lo:hi], v.size)
                    total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        # one sum per piece of the vocabulary
        got = counts.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        p = PRIOR * v.prior
        for r in got:
            p[r["piece"]] += r["n"]
        p[v.end] += documents
        p = p / p.sum()
    return np.log(np.maximum(p, 1e-300))


def word_scores(words: DataFrame, logp: np.ndarray, path: str) -> DataFrame:
    """Add lp, the natural log of the marginal probability, to (word, c)."""
    shared = words.sparkSession.sparkContext.broadcast(logp)

    def run(b):
        v, found = vocabulary(path), b.column("word").to_pylist()
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        inorder = [found[i] for i in order]
        lp = np.zeros(len(found))
        for lo, hi in _chunks(inorder):
            lp[order[lo:hi]] = Lattices(v, inorder[lo:hi]).forward(shared.value)[0]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp)], names=["word", "c", "lp"])
    return map_arrow(words, run, "word string, c long, lp double")


def score(docs: DataFrame, path: str, fold: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    held = F.coalesce(crc_mod("doc_id", fold) == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("train"))
    documents = docs.where("train").count()
    counts = stage(word_counts(docs), "lm-counts")
    known = counts.where("c > 0")
    sums = known.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = (sums["n"] or 0) + documents, sums["v"] + (documents > 0)  # the end counts as a token of each document
    logp = train(known, documents, path)
    rated = stage(word_scores(counts, logp, path), "lm-words")
    n = buckets(docs, "text", BUCKET_BYTES)
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "bucket")

    def needed(t: pa.Table) -> pa.Table:
        found = pc.unique(tokens(_large(t).combine_chunks())[0]).cast(pa.string())
        return pa.table({"bucket": pa.array(np.full(len(found), t.column("bucket")[0].as_py(), np.int64)), "word": found})

    norm, end_base = float(np.log10(total + 0.1 * (kinds + 1))), float(np.log10(documents + 0.1))
    end = float(logp[vocabulary(path).end])

    def rate(texts: pa.Table, words: pa.Table) -> pa.Table:
        m = texts.num_rows
        found, owner = tokens(_large(texts).combine_chunks())
        at = pc.index_in(found, value_set=words.column("word").cast(pa.large_string()).combine_chunks()).to_numpy(zero_copy_only=False)
        c, lp = words.column("c").to_numpy(), words.column("lp").to_numpy()

        def total_of(values):
            return np.bincount(owner, values[at], minlength=m)

        n_tokens = np.bincount(owner, minlength=m) + 1
        return pa.table({
            "doc_id": texts.column("doc_id"), "train": texts.column("train"), "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(total_of((c > 0).astype(float)).astype(np.int64) + int(documents > 0)),
            "base_score": pa.array(total_of(np.log10(c + 0.1)) + end_base - n_tokens * norm),
            "score": pa.array((total_of(lp) + end) / np.log(10))})

    asked = dealt.groupBy("bucket").applyInArrow(needed, "bucket long, word string")
    answered = asked.join(rated, "word").select("bucket", "word", "c", "lp")
    out = dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(
        rate, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
