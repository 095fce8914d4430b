"""Language identification by unigrams of pieces, marginalised over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary, fitted by expectation-maximisation over
all ways to cut words into pieces. A text's likelihood is the product over its words of a forward sum over all
segmentations. A worker keeps the likelihoods of words it has met.

Words are lower-cased letter runs, of any length: the forward pass goes over them letter by letter, and is rescaled on
the way, so that long runs don't underflow. The fit takes about 250 whole texts for each language (a parameter);
everything is scored whole.

A null text, or one without a letter, gives ``und`` with score 0; so does every text if nothing could be learnt. Null
languages are not learnt; repeated rows are scored each; ties go to the language first in order; further columns are
ignored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Known, Words, blocks, documents, mix, remainder, sampled, schema_with, text_of

TEXTS = 250
#: Letters and numbers of a lattice at a time; only a longer single run exceeds them. Letters between two rescalings.
LETTERS, CELLS, RESCALE = 200_000, 1_000_000, 16
RUNS = regex.compile(r"\p{L}+").findall
ROUNDS, PRIOR = 4, 200.0


def runs_of(word: str) -> list[str]:
    """A word's letter runs in lower case."""
    return RUNS(word.lower())


def vocabulary(path: str) -> dict[str, int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): k for k, i in enumerate(usual)}


class Prefixes:
    """Every beginning of a piece as a node: steps between them by a letter, and each one's piece (-1: none)."""

    def __init__(self, pieces: dict[str, int]):
        names = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        node = {"": 0} | {x: i for i, x in enumerate(names, 1)}
        self.piece = np.array([-1, *(pieces.get(x, -1) for x in names)], np.int64)
        self.longest = max(map(len, names), default=1)
        self.steps = Known()
        self.steps.add(mix(np.array([node[x[:-1]] << 21 | ord(x[-1]) for x in names], np.uint64)))

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes after these letters; 0 where no piece begins so."""
        return self.steps.find(mix((node << 21 | letter).astype(np.uint64))).astype(np.int64) + 1


def prefixes_of(pieces: dict[str, int]) -> Prefixes:
    return Prefixes(pieces)


class Lattice:
    """All pieces in all of the words, as edges. A letter no piece has is piece ``len(vocabulary)``."""

    def __init__(self, words: list[str], prefixes: Prefixes, none: int):
        letters = np.frombuffer("".join("▁" + x for x in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lens = np.fromiter((len(x) + 1 for x in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        last = np.cumsum(lens)
        start = np.arange(len(letters)) - (last - lens)[word]
        # All starts go on letter by letter; those that no piece begins with drop out.
        at, node, parts = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        for k in range(prefixes.longest):
            inside = at + k < last[word[at]]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = prefixes.step(node, letters[at + k])
            piece = prefixes.piece[node]
            if k == 0:
                parts.append((at, np.ones(len(at), np.int64), np.where(piece >= 0, piece, none)))
            else:
                some = piece >= 0
                parts.append((at[some], np.full(int(some.sum()), k + 1), piece[some]))
            at, node = at[node > 0], node[node > 0]
        at, size, self.piece = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        self.word, self.start = word[at], start[at]
        self.end = self.start + size
        self.lens, self.longest = lens, prefixes.longest

    def forward(self, theta: np.ndarray, back: bool = False) -> np.ndarray:
        """log alpha[word, place, language] for probabilities theta[piece, language]; from the words' ends, if ``back``."""
        n, k, most = len(self.lens), theta.shape[1], int(self.lens.max(initial=0))
        start, end = (self.lens[self.word] - self.end, self.lens[self.word] - self.start) if back else (self.start, self.end)
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(1, most + 2))
        alpha, scale = np.zeros((n, most + 1, k)), np.zeros((n, most + 1, k))  # the factors' logarithms
        alpha[:, 0] = 1
        for to in range(1, most + 1):
            e = order[cuts[to - 1] : cuts[to]]
            add = alpha[self.word[e], start[e]] * theta[self.piece[e]]
            for c in range(k):
                alpha[:, to, c] = np.bincount(self.word[e], add[:, c], n)
            scale[:, to] = scale[:, to - 1]
            if to % RESCALE == 0:  # what the next places are made of keeps one scale
                window = slice(max(0, to - self.longest), to + 1)
                top = alpha[:, window].max(axis=1)
                top[top <= 0] = 1
                alpha[:, window] /= top[:, None]
                scale[:, window] += np.log(top)[:, None]
        with np.errstate(divide="ignore"):
            return np.log(alpha) + scale

    def likelihood(self, theta: np.ndarray) -> np.ndarray:
        """Log likelihoods [word, language]."""
        return self.forward(theta)[np.arange(len(self.lens)), self.lens]

    def expected(self, theta: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by words with these counts; theta for one language."""
        alpha, beta = (self.forward(theta[:, None], back)[:, :, 0] for back in (False, True))
        whole = alpha[np.arange(len(self.lens)), self.lens]
        with np.errstate(divide="ignore"):
            use = alpha[self.word, self.start] + np.log(theta[self.piece]) + beta[self.word, self.lens[self.word] - self.end] - whole[self.word]
        return np.bincount(self.piece, np.exp(use) * counts[self.word], len(theta))


def lattices(words: list[str], prefixes: Prefixes, none: int, languages: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of words of like lengths, with the places of these words; each of bounded size, but for a single long run."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lens, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        # As many as fit: the longest is the last.
        while to < len(order):
            step = min(len(order), to + max(1, (to - at) // 2))
            longest, n = int(lens[order[step - 1]]) + 2, step - at
            if n * longest > LETTERS or n * longest * languages > CELLS:
                break
            to = step
        some = order[at:to]
        yield some, Lattice([words[i] for i in some.tolist()], prefixes, none)
        at = to


def learn(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and theta[piece, language], from word counts of each language."""
    langs, prefixes, size = sorted(counts), prefixes_of(pieces), len(pieces) + 1
    fitted = []
    for lang in langs:
        words = sorted(counts[lang])
        n = np.array([counts[lang][w] for w in words], float)
        theta = np.full(size, 1 / size)
        for _ in range(rounds):
            use = sum(lattice.expected(theta, n[some]) for some, lattice in lattices(words, prefixes, size - 1, 1))
            theta = (use + 1e-3) / (use.sum() + 1e-3 * size)
        fitted.append(use)
    pooled = sum(fitted) + 0.01
    pooled = pooled / pooled.sum()
    theta = np.stack([(u + PRIOR * pooled) / (u.sum() + PRIOR) for u in fitted], axis=1)
    theta[-1] = theta[-1].mean()  # an unknown letter tells nothing
    return langs, theta


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.update((lang, r) for w in text.split() for r in runs_of(w))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", text_of().alias("text")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary_path: str, texts: int = TEXTS) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """From (doc_id, text, lang): a bounded sample of whole texts for each language (parameter ``texts``)."""
    pieces = vocabulary(vocabulary_path)
    some = sampled(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang", texts)
    counts: dict[str, dict[str, int]] = {}
    for r in word_counts(some).toLocalIterator():
        counts.setdefault(r.lang, {})[r.word] = r.n
    return (*learn(counts, pieces), pieces) if counts else ([], np.zeros((len(pieces) + 1, 0)), pieces)


class Scorer:
    def __init__(self, langs: list[str], theta: np.ndarray, pieces: dict[str, int]):
        self.langs, self.theta, self.prefixes = langs, theta, prefixes_of(pieces)
        self.known = Known(200_000)
        self.log, self.letters = np.zeros((0, len(langs))), np.zeros(0, bool)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods and whether there is a letter, for words."""
        each = [runs_of(w) for w in texts]
        place = {r: i for i, r in enumerate(dict.fromkeys(r for x in each for r in x))}
        runs = list(place)
        logs = np.zeros((len(runs), len(self.langs)))
        for some, lattice in lattices(runs, self.prefixes, len(self.theta) - 1, len(self.langs)):
            logs[some] = lattice.likelihood(self.theta)
        owner = np.array([i for i, x in enumerate(each) for _ in x], np.int64)
        index = np.array([place[r] for x in each for r in x], np.int64)
        out = np.stack([np.bincount(owner, logs[index, c], len(each)) for c in range(len(self.langs))], axis=1)
        return out, np.array([bool(x) for x in each], bool)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: und) and its posterior."""
        words = Words(column)
        if self.known.n > self.known.most:
            self.known.clear()
            self.log, self.letters = self.log[:0], self.letters[:0]

        def learn_words(places: np.ndarray) -> None:
            data = words.buf.tobytes()
            log, letters = self.words([data[a:b].decode() for a, b in zip(words.starts[places].tolist(), words.ends[places].tolist())])
            self.log, self.letters = np.concatenate([self.log, log]), np.concatenate([self.letters, letters])

        slots = self.known.slots_for(words.hashes(), learn_words)
        n = len(column)
        total = np.stack([np.bincount(words.rows, self.log[slots, c], n) for c in range(len(self.langs))], axis=1)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.bincount(words.rows, self.letters[slots], n) > 0
        return np.where(some, best, -1), np.where(some, score, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, dict[str, int]]) -> DataFrame:
    """All columns of docs, and lang_pred and score."""
    langs = model[0]
    docs = docs.drop("lang_pred", "score")
    schema = schema_with(docs, ("lang_pred", "string"), ("score", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model) if langs else None
        names = np.array([*langs, "und"], object)
        for batch in batches:
            filled = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").fill_null(""))
            at = 0
            for some in blocks(filled):
                index, score = scorer.texts(some.column("text")) if scorer else (np.full(some.num_rows, -1), np.zeros(some.num_rows))
                own = batch.slice(at, some.num_rows)
                at += some.num_rows
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names[index], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where("not held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
