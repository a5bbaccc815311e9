"""Language identification by segmentation-marginalised unigrams (operator 8).

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is the sum over all
its segmentations into pieces, by the forward algorithm; a text's log score is the sum over its words, its confidence the
posterior of the best language under equal priors.  Piece probabilities are estimated from labelled rows by expectation
maximisation: forward and backward sums give the expected count of each piece.

Training reads about ``max_rows`` labelled rows of each language, chosen by a hash of the row (all rows where a language
has fewer); the bound is a parameter.  All words of these rows are learned from, of any length.  The word counts stay
distributed: each round of the maximisation is a pass over them that returns expected counts of pieces, so the driver
holds pieces x languages numbers and no words.  Prediction is one pass over whole texts without a shuffle, ``SLICE_DOCS``
documents or ``SLICE_CHARS`` letters at a time; a word is scored once per slice however often it occurs, and the forward
recursion runs over all distinct words of one length together.

``gain`` compares the best language with the untrained piece model: at most 0 means that no language explains the text
better than pieces drawn without regard to any language, as with noise or scripts that were never learned.

Defined cases: a null text or one without letters gives ``und`` with score 0 and gain 0; rows without lang or text are
never learned from; without any labelled row every text is ``und``; equal posteriors give the language that sorts first;
repeated rows are predicted alike; an empty table gives an empty result; other columns are ignored.  The labels must be a
set of languages: memory grows with their number.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, remove, settle
from .wordcodes import list_codes, slices, without_empty

EM_ROUNDS = 2
FLOOR = 1e-7  # probability of a piece never seen in a language, and of a single letter outside the vocabulary
SLICE_DOCS, SLICE_CHARS = 500, 1_500_000
CHUNK_LETTERS = 100_000  # letters of equally long words that are scored together
RESCALE = 16  # letters after which the sums of a word are brought back into range
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(model_path: str) -> list[str]:
    """Pieces of letters of a sentencepiece model, lower case, without its word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = {sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size())}
    return sorted(x for x in out if x.isalpha())


def _letters(words: list[str], n: int) -> np.ndarray:
    """Words of n letters as a matrix of code points."""
    return np.array(words, dtype=f"<U{n}").view("<u4").reshape(len(words), n).astype(np.uint64)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


class _Edges:
    """Which piece each substring of equally long words is."""

    def __init__(self, model: PieceModel, letters: np.ndarray):
        self.model, self.n = model, letters.shape[1]
        self.past = np.zeros((self.n + 1, len(letters)), np.uint64)  # hashes of all beginnings
        with np.errstate(over="ignore"):
            for i in range(self.n):
                self.past[i + 1] = (self.past[i] + letters[:, i] + np.uint64(1)) * _BASE

    def __call__(self, j: int, i: int) -> np.ndarray:
        m = self.model
        with np.errstate(over="ignore"):
            h = self.past[i] - self.past[j] * m.powers[i - j]
        at = m.slots[(h >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(at)  # most substrings are no piece
        out = np.full(len(h), m.unknown if i == j + 1 else m.none)
        at = np.minimum(np.searchsorted(m.hashes, h[some]), len(m.hashes) - 1)
        same = m.hashes[at] == h[some]
        out[some[same]] = m.order[at[same]]
        return out

    def into(self, i: int) -> range:
        return range(max(0, i - self.model.longest), i)

    def out_of(self, j: int) -> range:
        return range(j + 1, min(self.n, j + self.model.longest) + 1)


class PieceModel:
    """Piece probabilities per language and of the untrained model, and the log probability of words in each of them."""

    def __init__(self, pieces: list[str], languages: list[str]):
        self.languages, self.longest = languages, max(map(len, pieces))
        hashes = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for n, own in _by_length(pieces).items():
                for column in _letters([pieces[i] for i in own], n).T:
                    hashes[own] = (hashes[own] + column + np.uint64(1)) * _BASE
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE)), dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.slots = np.zeros(1 << 20, bool)
        self.slots[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.unknown, self.none = len(pieces), len(pieces) + 1
        start = np.array([0.05 ** len(p) for p in pieces])
        self.p = np.tile(np.append(start / start.sum(), [FLOOR, 0.0]), (len(languages) + 1, 1))  # the last stays untrained

    def _chunks(self, words: list[str]):
        """(indices, edges) of words of one length, some at a time."""
        for n, own in _by_length(words).items():
            step = max(1, CHUNK_LETTERS // n)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                yield part, _Edges(self, _letters([words[i] for i in part], n))

    def log_probs(self, words: list[str]) -> np.ndarray:
        """A row per word, a column per language, then the untrained model."""
        out = np.zeros((len(words), len(self.p)))
        p = np.ascontiguousarray(self.p.T)
        for part, edges in self._chunks(words):
            alpha, shift = {0: np.ones((len(part), len(self.p)))}, np.zeros((len(part), len(self.p)))
            for i in range(1, edges.n + 1):
                alpha[i] = sum(alpha[j] * p[edges(j, i)] for j in edges.into(i))
                alpha.pop(i - self.longest, None)
                if i % RESCALE == 0:  # keeps long words in range
                    top = np.maximum.reduce(list(alpha.values()))
                    shift += np.log(top)
                    alpha = {j: x / top for j, x in alpha.items()}
            out[part] = np.log(alpha[edges.n]) + shift
        return out

    def expected(self, words: list[str], counts: np.ndarray, k: int) -> np.ndarray:
        """Expected number of uses of each piece in words that occur so often, in the k-th language."""
        p, out = self.p[k], np.zeros(self.p.shape[1])
        for part, edges in self._chunks(words):
            n, weight = edges.n, counts[part].astype(float)
            # sums up to and from each place, each with the logarithm by which it was scaled
            alpha, beta = np.ones((n + 1, len(part))), np.ones((n + 1, len(part)))
            log_a, log_b = np.zeros((n + 1, len(part))), np.zeros((n + 1, len(part)))
            for i in range(1, n + 1):
                base = log_a[i - 1]
                alpha[i] = sum(alpha[j] * (np.exp(log_a[j] - base) if n > RESCALE else 1.0) * p[edges(j, i)] for j in edges.into(i))
                log_a[i] = base
                if i % RESCALE == 0 and n > RESCALE:
                    log_a[i] = base + np.log(alpha[i])
                    alpha[i] = 1.0
            total = np.log(alpha[n]) + log_a[n]
            for j in range(n - 1, -1, -1):
                base, uses = log_b[j + 1], 0.0
                for i in edges.out_of(j):
                    piece = edges(j, i)
                    step = p[piece] * beta[i] * (np.exp(log_b[i] - base) if n > RESCALE else 1.0)
                    uses = uses + step
                    out += np.bincount(piece, weight * alpha[j] * step * np.exp(log_a[j] + base - total), minlength=len(out))
                beta[j], log_b[j] = uses, base
                if (n - j) % RESCALE == 0 and n > RESCALE:
                    log_b[j] = base + np.log(beta[j])
                    beta[j] = 1.0
        return out

    def take(self, expected: np.ndarray) -> None:
        """Probabilities from the expected counts (a row per language)."""
        found = expected[:, : self.unknown]
        found = np.maximum(found / np.maximum(found.sum(axis=1, keepdims=True), 1e-300), FLOOR)
        self.p[:-1, : self.unknown] = found / found.sum(axis=1, keepdims=True)

    def fit(self, counts: dict[str, dict[str, int]], rounds: int = EM_ROUNDS) -> None:
        """Expectation maximisation on word counts in memory."""
        for _ in range(rounds):
            rows = [(list(counts.get(lang, {})), np.array(list(counts.get(lang, {}).values()))) for lang in self.languages]
            self.take(np.array([self.expected(words, n, k) for k, (words, n) in enumerate(rows)]))


def letter_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct runs of letters, lower case; the code of every run in order; where each text's begin."""
    return without_empty(*list_codes(pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+")))


def train(labelled: DataFrame, model_path: str, max_rows: int = 4000) -> PieceModel | None:
    """A model of the languages in ``labelled`` (text, lang); None if there is no labelled row."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return None
    chosen = F.lit(False)
    drawn = F.xxhash64("doc_id", "lang", "text")  # any of 2**64 values: a share of them, however small, can be asked for
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (drawn <= int(-(2**63) + min(2**64 - 1, 2**64 * max_rows // n))))

    def count(batches):
        for part in slices(batches, 1, SLICE_DOCS, SLICE_CHARS):
            distinct, codes, starts = letter_words(part.column(1))
            langs = np.repeat(np.array(part.column(0).to_pylist(), dtype=object), np.diff(starts))
            for lang in set(langs.tolist()):
                n = np.bincount(codes[langs == lang], minlength=len(distinct))
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([distinct[i] for i in own], pa.string()), pa.array(n[own])], ["lang", "word", "n"])

    summed = in_arrow(rows.where(chosen).select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = settle(summed, "word-counts")
    model = PieceModel(vocabulary_pieces(model_path), sorted(sizes))
    for _ in range(EM_ROUNDS):
        model.take(_expected(counts, model))
    remove(labelled.sparkSession, counts)
    return model


def _expected(counts: DataFrame, model: PieceModel) -> np.ndarray:
    """A row of expected piece counts for each language: every task returns the sums over its words."""
    number = {lang: k for k, lang in enumerate(model.languages)}

    def run(batches):
        total = np.zeros((len(number), model.p.shape[1]))
        for b in batches:
            words, n = b.column(1).to_pylist(), b.column(2).to_numpy()
            langs = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            for k in np.unique(langs).tolist():
                own = np.flatnonzero(langs == k)
                total[k] += model.expected([words[i] for i in own], n[own], k)
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], ["k", "piece", "n"])

    out = np.zeros((len(number), model.p.shape[1]))
    for k, piece, n in in_arrow(counts.select("lang", "word", "n"), run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n")).collect():
        out[k, piece] = n  # pieces x languages at most
    return out


def _best(model: PieceModel | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior, gain per letter and number of words of each text."""
    distinct, codes, starts = letter_words(texts)
    n = np.diff(starts)
    if model is None or not len(codes):
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), n
    table = model.log_probs(distinct)
    own = np.vstack([np.column_stack([table, np.fromiter(map(len, distinct), float, len(distinct))])[codes], np.zeros((1, table.shape[1] + 1))])
    sums = np.add.reduceat(own, starts[:-1], axis=0)
    scores, untrained, letters = sums[:, :-2], sums[:, -2], sums[:, -1]
    top = scores.max(axis=1)
    post, gain = 1.0 / np.exp(scores - top[:, None]).sum(axis=1), (top - untrained) / np.maximum(letters, 1)
    return [model.languages[k] if m else "und" for k, m in zip(scores.argmax(axis=1), n)], np.where(n > 0, post, 0.0), np.where(n > 0, gain, 0.0), n


PREDICTION = "doc_id long, lang_pred string, score double, gain double, n_words long"


def predict(docs: DataFrame, model: PieceModel | None) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the prediction), gain and n_words of every document."""

    def run(batches):
        for part in slices(batches, 1, SLICE_DOCS, SLICE_CHARS):
            lang, score, gain, n = _best(model, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gain, pa.float64()), pa.array(n, pa.int64())],
                                             ["doc_id", "lang_pred", "score", "gain", "n_words"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PREDICTION)


def with_prediction(docs: DataFrame, model: PieceModel | None) -> DataFrame:
    """The documents, all columns, with lang_pred, score and gain, which take the place of columns of these names; the words
    never leave the task that reads the text."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.drop("lang_pred", "score", "gain")
    at = docs.columns.index("text")

    def run(batches):
        for part in slices(batches, at, SLICE_DOCS, SLICE_CHARS):
            lang, score, gain, _ = _best(model, part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gain, pa.float64())],
                                             [*part.schema.names, "lang_pred", "score", "gain"])

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("gain", DoubleType())
    return in_arrow(docs, run, schema)
