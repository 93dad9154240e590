"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated.

Terms are lower-cased words and four-letter beginnings of words. The vocabulary doesn't look at labels: it holds the terms that a share between LEAST and MOST of all documents has. What
rarer terms would add are chance meetings of names; the commonest are of no weight. A term weighs its count times the third power of its idf over all documents, and more if the examples'
labels differ in it beyond chance; none weighs less. Examples of both labels are indexed with all their terms of the vocabulary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back
from .samples import labelled_ids, labelled_texts, remainder
from .texts import slices

#: Bound of the fit: examples of each class.
PER_CLASS = 2000
#: Shares of all documents between which a term is in the vocabulary: so it has at most 1 / LEAST times the different terms of a document on average.
LEAST, MOST = 0.01, 0.5
#: Documents and bytes of a chunk when frequent terms are looked for.
CHUNK, CHUNK_BYTES = 2048, 2 << 20
MODULUS, HELD_OUT = 4, 2
NEIGHBOURS = 15
#: Standard errors by which the best of some thousand terms differs between labels by chance.
CHANCE = 4.0
BLOCK = 32
#: Share of the examples that a term's list may have to be read whole.
LONG = 0.15
THRESHOLD = 0.3
MASS = 0.25
BEGIN = 4
#: Of the idf in a term's weight.
POWER = 3
NO_WORD = r"[^\pL\pN_]+"


def term_counts(texts, vocabulary=None):
    """(document, term, count) as three arrays for an Arrow array of texts, and the terms: those of the vocabulary, or all that occur. A beginning ends in *."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.string())), pattern=NO_WORD)
    words, offsets = split.flatten(), split.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    begins = pc.utf8_slice_codeunits(words, 0, BEGIN)
    long = pc.greater_equal(pc.utf8_length(words), BEGIN)
    starred = pc.if_else(long, pc.binary_join_element_wise(begins, "*", ""), None)
    whole = pc.if_else(pc.greater(pc.binary_length(words), 0), words, None)
    if vocabulary is None:
        both = pa.concat_arrays([whole, starred]).dictionary_encode()
        code, vocabulary = both.indices, both.dictionary
    else:
        code = pa.concat_arrays([pc.index_in(whole, vocabulary), pc.index_in(starred, vocabulary)])
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    pair = np.concatenate([doc, doc])[known] * max(1, len(vocabulary)) + code.drop_null().to_numpy().astype(np.int64)
    pairs, counts = np.unique(pair, return_counts=True)
    return pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), counts, vocabulary


def sparse(counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms, ascending, and their counts, of a dictionary or of two such arrays."""
    ts, ns = (sorted(counts), [counts[t] for t in sorted(counts)]) if isinstance(counts, dict) else counts
    return np.array(ts, np.int64), np.array(ns, np.float64)


class Index:
    """Examples' unit vectors in postings by term, with the largest weight of each term in each block of examples."""

    def __init__(self, terms: list[str], weight: np.ndarray, examples: list[tuple]):
        self.terms, self.weight, self.examples = terms, weight, examples
        self.slope, self.offset = 1.0, 0.0

    #: What is made of the examples where it is first asked for: the driver, which only passes the examples on, never holds it.
    MADE = ("ids", "labels", "blocks", "post", "value", "start", "most", "block_of", "forward", "forward_term", "forward_value")

    def __getattr__(self, name: str):
        if name not in Index.MADE:
            raise AttributeError(name)
        self._make()
        return self.__dict__[name]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in Index.MADE}

    def _make(self) -> None:
        rows = [(d, y, self.unit(c)) for d, y, c in self.examples]
        rows = [(d, y, v) for d, y, v in rows if len(v[0])]
        rows.sort(key=lambda r: (int(r[2][0][np.argmax(r[2][1])]), r[0]))  # alike examples share blocks, so that the bounds are tight
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.float64)
        self.blocks = max(1, -(-len(rows) // BLOCK))
        where = np.concatenate([np.full(len(v[0]), i) for i, (_, _, v) in enumerate(rows)] or [np.zeros(0, np.int64)]).astype(np.int32)
        term = np.concatenate([v[0] for _, _, v in rows] or [np.zeros(0, np.int64)])
        value = np.concatenate([v[1] for _, _, v in rows] or [np.zeros(0)])
        order = np.argsort(term, kind="stable")
        self.post, self.value = where[order], value[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.zeros((len(self.terms), self.blocks))
        np.maximum.at(self.most, (term, where // BLOCK), value)
        self.block_of = np.arange(len(rows)) // BLOCK
        long = np.diff(self.start)[term] > LONG * len(rows)  # where is ascending, so these are vectors by example
        self.forward = np.searchsorted(where[long], np.arange(len(rows) + 1))
        self.forward_term, self.forward_value = term[long], value[long]

    def unit(self, counts) -> tuple[np.ndarray, np.ndarray]:
        return self.unit_of(*sparse(counts))

    def unit_of(self, ts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ws = counts * self.weight[ts]
        norm = np.sqrt(np.square(ws).sum())
        return (ts, ws / norm) if norm > 0 else (ts[:0], ws[:0])

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int, float]]:
        """The k examples of largest cosine above 0: (cosine, doc_id, label), ties to the smaller doc_id.

        Lists of the rarer terms are read whole. The others are looked at only for examples whose block's bound, with what they have by then, reaches what the k-th best has.
        """
        ts, ws = vector
        if not len(ts) or not len(self.ids):
            return []
        # terms with long lists only bound a block at first: ws @ most is what they can add to any of its examples
        short = self.start[ts + 1] - self.start[ts] <= LONG * len(self.ids)
        scores = self._sum(ts[short], ws[short])
        if not short.all():
            more = ws[~short] @ self.most[ts[~short]]
            top = scores if without is None else np.where(self.ids == without, 0, scores)
            floor = np.partition(top, -k)[-k] if len(top) >= k else 0.0
            at = np.flatnonzero(scores + more[self.block_of] >= floor - 1e-9)
            query = np.zeros(len(self.terms))
            query[ts[~short]] = ws[~short]
            scores = np.where(scores + more[self.block_of] >= floor - 1e-9, scores, 0)
            scores[at] += self._dots(at, query)
        if without is not None:
            scores[self.ids == without] = 0
        found = np.flatnonzero(scores > 0)
        if len(found) > 4 * k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k] - 1e-9]
        best = sorted((-round(s, 12), d, y) for s, d, y in zip(scores[found].tolist(), self.ids[found].tolist(), self.labels[found].tolist(), strict=True))[:k]
        return [(-s, d, y) for s, d, y in best]

    def _sum(self, ts: np.ndarray, ws: np.ndarray) -> np.ndarray:
        """What these terms' lists add to each example."""
        a, n = self.start[ts], self.start[ts + 1] - self.start[ts]
        lists = [slice(i, i + k) for i, k in zip(a.tolist(), n.tolist(), strict=True)]
        if not lists:
            return np.zeros(len(self.ids))
        values = np.concatenate([self.value[x] for x in lists]) * np.repeat(ws, n)
        return np.bincount(np.concatenate([self.post[x] for x in lists]), values, len(self.ids)).astype(float)

    def _dots(self, examples: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Products of these examples' long-list terms with a query."""
        a, n = self.forward[examples], self.forward[examples + 1] - self.forward[examples]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(np.arange(len(examples)), n), query[self.forward_term[at]] * self.forward_value[at], len(examples)).astype(float)

    def vote(self, near: list[tuple[float, int, float]]) -> float:
        """Votes weighted by cosine; MASS of weight votes for nothing."""
        weight = sum(s for s, _, _ in near)
        return sum(s * y for s, _, y in near) / (weight + MASS)

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -40, 40))))


def relevance(terms: int, examples: list[tuple]) -> np.ndarray:
    """A factor of at least 1 for each term: 1, and what the root of its log-likelihood ratio between the examples' labels has beyond CHANCE."""
    has = np.zeros((2, terms))
    for _, y, counts in examples:
        has[y, sparse(counts)[0]] += 1
    n = np.array([[sum(y == k for _, y, _ in examples)] for k in (0, 1)], float)

    def part(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(of, 1e-9)), 0)

    share = has.sum(0) / n.sum()
    ratio = 2 * (part(has, n * share) + part(n - has, n * (1 - share))).sum(0)
    return 1 + np.maximum(0, np.sqrt(np.maximum(ratio, 0)) - CHANCE)


def calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on votes (Newton steps, a small ridge on the slope)."""
    x = np.stack([votes, np.ones_like(votes)], 1)
    at, ridge = np.zeros(2), np.diag([1e-2, 1e-4]) * weights.sum() / 100
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(2), x.T @ (weights * (labels - p)) - ridge @ at)
        at = at + step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def frequent_terms(docs: DataFrame, least: float = LEAST, most: float = MOST) -> tuple[list[str], np.ndarray, int]:
    """The terms that between least and most of all documents have, ascending, their idf over all documents, and the number of documents.

    Chunks of documents name the terms that half of `least` of their documents have, with their counts; where a chunk doesn't name a term, at most that half has it. So a sum rules out
    all terms but some 2 / least times the different terms of a document on average, and a second pass counts those left in all documents.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = texts.count()

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 0, CHUNK, CHUNK_BYTES):
                _, term, _, words = term_counts(part.column(0))
                many = np.bincount(term, minlength=len(words))
                often = np.flatnonzero(many >= max(1, least / 2 * part.num_rows))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(often)), pa.array(many[often], pa.int64()), pa.array(np.full(len(often), part.num_rows), pa.int64())], names=["term", "df", "n"])

    sums = texts.mapInArrow(named, "term string, df bigint, n bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    names = sorted(r["term"] for r in sums.where(F.col("df") + least / 2 * (total - F.col("n")) >= least * total).select("term").collect())
    shipped = docs.sparkSession.sparkContext.broadcast(names)

    def counted(batches):
        import pyarrow as pa

        vocabulary = pa.array(shipped.value, pa.string())
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, 0, CHUNK):
                df += np.bincount(term_counts(part.column(0), vocabulary)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], names=["i", "df"])

    got = texts.mapInArrow(counted, "i int, df bigint").groupBy("i").agg(F.sum("df").alias("df")).where((F.col("df") >= least * total) & (F.col("df") <= most * total)).collect()
    kept = sorted((names[r["i"]], r["df"]) for r in got)
    return [t for t, _ in kept], np.array([np.log((total + 1) / (n + 1)) for _, n in kept]), total


def own_votes(spark: SparkSession, index: Index) -> np.ndarray:
    """The vote of each of the index's examples among the others, taken on the executors."""
    shipped = spark.sparkContext.broadcast(index)

    def run(batches):
        import pyarrow as pa

        index = shipped.value
        for batch in batches:
            mine = [index.examples[i] for i in batch.column(0).to_pylist()]
            votes = [index.vote(index.nearest(index.unit(c), without=d)) for d, _, c in mine]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    n = len(index.examples)
    got = spark.range(0, n, 1, -(-n // 512)).mapInArrow(run, "id bigint, vote double").toArrow()
    shipped.destroy()
    out = np.zeros(n)
    out[got.column("id").to_numpy()] = got.column("vote").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> Index:
    """Learns index and calibration from at most per_class examples of each class that aren't held out; the vocabulary and its idf are those of all documents.

    The driver gets the vocabulary and the examples' counts, both bounded; postings are made and votes taken on the executors. Without examples of both classes (no labels, or no documents for them) there is no index, and every
    document gets the share of label 1 among the labels that aren't held out (0 without labels). Of documents with the same id the one of the least text is the example.
    """
    ids, counts = labelled_ids(labels, "toxic", modulus, held_out, per_class)
    terms, idf, _ = frequent_terms(docs)
    bare = Index(terms, np.power(idf, POWER), [])
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches):
        import pyarrow as pa

        vocabulary = pa.array(known.value, pa.string())
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                doc, term, count, _ = term_counts(part.column(1), vocabulary)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["doc_id", "y", "ts", "ns"])

    rows = labelled_texts(docs, ids).select("doc_id", "text", "y").mapInArrow(vectors, "doc_id bigint, y int, ts array<int>, ns array<int>").toArrow().combine_chunks()
    n = {y: int((rows["y"].to_numpy() == y).sum()) for y in (0, 1)}
    if not n[0] or not n[1]:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        bare.slope, bare.offset = 0.0, float(np.clip(np.log(max(share, 1e-18)) - np.log(max(1 - share, 1e-18)), -40, 40))
        return bare
    # slices of two arrays: dictionaries of a million counts would take the driver some 100 bytes each
    ts, ns = (rows[c].combine_chunks() for c in ("ts", "ns"))
    at, ts, ns = ts.offsets.to_numpy() - ts.offsets[0].as_py(), ts.flatten().to_numpy(), ns.flatten().to_numpy()
    examples = sorted(zip(rows["doc_id"].to_pylist(), rows["y"].to_pylist(), [(ts[a:b], ns[a:b]) for a, b in zip(at, at[1:], strict=False)], strict=True), key=lambda e: e[:2])
    index = Index(terms, np.power(idf, POWER) * relevance(len(terms), examples), examples)
    votes = own_votes(docs.sparkSession, index)
    ys = np.array([y for _, y, _ in examples], np.float64)
    share = {y: counts[y] / n[y] for y in (0, 1)}  # the sample's classes weigh as in all labels
    index.slope, index.offset = calibrated(votes, ys, np.where(ys == 1, share[1], share[0]) / max(share.values()))
    return index


def score_documents(docs: DataFrame, index: Index, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score, predicted, and the nearest examples as evidence (evidence_ids, evidence_scores) for every row.

    A null text counts as empty; a text without terms of the vocabulary has no neighbours and gets the score of no vote. Rows are scored one by one from their whole texts: ties
    and repeats get equal scores; a very long text is taken alone. No rows give no rows. No shuffle. Columns that aren't kept are not read; a kept column of the name of a new one is refused: `without_toxic` keeps any.
    """
    if clash := {"score", "predicted", "evidence_ids", "evidence_scores"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    return _scored(docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")), index, keep, threshold, lambda part: part.column(len(keep)))


def _scored(rows: DataFrame, index: Index, keep: tuple[str, ...], threshold: float, text_of) -> DataFrame:
    """The first columns of rows, by keep, and what score_documents adds; text_of takes the texts from an Arrow batch."""
    fields = [f"`{k}` {f.dataType.simpleString()}" for k, f in zip(keep, rows.schema, strict=False)]
    shipped = rows.sparkSession.sparkContext.broadcast(index)  # its size is bounded by the fit's parameters

    def run(batches):
        import pyarrow as pa

        index = shipped.value
        vocabulary, none = pa.array(index.terms, pa.string()), index.score(0.0)
        for batch in batches:
            texts = pa.record_batch([text_of(batch).fill_null("")], names=["text"])
            at_row = 0
            for piece in slices(texts, 0, CHUNK):
                part = batch.slice(at_row, piece.num_rows)
                at_row += piece.num_rows
                doc, term, count, _ = term_counts(piece.column(0), vocabulary)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                scores, ids, sims = [], [], []
                for i in range(part.num_rows):
                    near = index.nearest(index.unit_of(term[at[i] : at[i + 1]], count[at[i] : at[i + 1]])) if len(index.ids) else []
                    scores.append(index.score(index.vote(near)) if near else none)
                    ids.append([d for _, d, _ in near[:3]])
                    sims.append([s for s, _, _ in near[:3]])
                columns = [*(part.column(i) for i in range(len(keep))), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted", "evidence_ids", "evidence_scores"])
        batch = texts = piece = part = doc = term = count = columns = None
        give_back()

    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int", "evidence_ids array<bigint>", "evidence_scores array<double>"]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with its columns, whatever their names. Each text goes to Python once, within its row."""
    packed = docs.select(F.struct("*").alias("row"))

    def text_of(batch):
        import pyarrow.compute as pc

        return pc.struct_field(batch.column(0), "text")

    return _scored(packed, fit(docs, labels), ("row",), threshold, text_of).where("predicted = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, index)
    return scored.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted", "evidence_ids", "evidence_scores")
