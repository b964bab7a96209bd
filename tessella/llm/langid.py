"""Language identification by a linear-chain conditional random field over words.

Words carry affix, character n-gram and lexicon features with weights by language; learned transitions tie
neighbouring words, so code-switched text is labelled word by word. Forward-backward gives each word's
marginals; a text's language is the one of highest mean marginal. The field is fitted in one task on a bounded
sample of labelled texts, from which it also makes code-switched training sequences. Texts of any length are
scored whole: sequences are cut into blocks whose transfer matrices are multiplied first, so many blocks advance
at once and the result is that of the plain recursion.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tessella.session import ship

#: Label of a text without letters.
UNDETERMINED = "und"
#: Labelled texts of each language in the training sample at most, and training words in all.
SAMPLE_TEXTS = 250
SAMPLE_WORDS = 60_000
#: Parts in which the rows of a language are ranked first.
RANK_PARTS = 32
#: Rows of the hashed weight table.
SLOTS = 1 << 15
#: Words of a training sequence, of a block in scoring, and about so many scored at once.
SEQUENCE = 48
BLOCK = 32
CHUNK_WORDS = 120_000
#: Remembered words of a worker; beyond it the memory starts anew.
REMEMBERED = 200_000
EPOCHS = 6
BATCH = 48
RATE = 0.3
DECAY = 1e-5

_PREDICTED = (StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("certainty", DoubleType()))
_RUN = StructType(
    [
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("lang", StringType()),
        StructField("words", IntegerType()),
        StructField("score", DoubleType()),
    ]
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """Languages in order, weights by slot and language, log transitions, and the languages whose lexicon has a word."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, tuple[int, ...]] = field(default_factory=dict)


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Slots of a word's features: affixes of 1 to 3 letters, n-grams of 2 and 3 with word ends, lexicon languages."""
    data = f"<{word}>"
    names = [data[i : i + 2] for i in range(len(data) - 1)]
    names += [data[i : i + 3] for i in range(len(data) - 2)]
    names += ["p" + word[:k] for k in (1, 2, 3)]
    names += ["s" + word[-k:] for k in (1, 2, 3)]
    names += [f"lexicon {k}" for k in lexicon.get(word, ())]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def _training_sequences(samples: list[tuple[str, str]], number: dict[str, int], rng: np.random.Generator):
    """Arrays of words and labels, SEQUENCE words each: half runs of one text, half spliced spans of several."""
    texts = [(w, number[lang]) for text, lang in samples if (w := words_of(text))]
    rng.shuffle(texts)
    share = max(SEQUENCE, SAMPLE_WORDS // max(1, len(texts)))
    whole, spans = [], []
    for n, (words, label) in enumerate(texts):
        at = int(rng.integers(0, max(1, len(words) - share)))
        end = min(len(words), at + share)
        while at < end:
            size = int(rng.integers(3, 13)) if n % 2 else SEQUENCE
            (spans if n % 2 else whole).append((words[at : min(at + size, end)], label))
            at += size
    rng.shuffle(spans)
    flat = [(w, label) for piece, label in [*spans, *whole] for w in piece]
    flat += flat[: -len(flat) % SEQUENCE]
    while flat and len(flat) % SEQUENCE:
        flat += flat[: -len(flat) % SEQUENCE]
    words = [w for w, _ in flat]
    labels = np.array([k for _, k in flat], dtype=np.int64)
    return words, labels


def train(samples: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fit the field to (text, language) rows by stochastic gradient on the likelihood of word labels."""
    languages = sorted({lang for text, lang in samples if words_of(text)})
    size = len(languages)
    model = Model(languages, np.zeros((SLOTS, max(size, 1))), np.zeros((max(size, 1), max(size, 1))))
    if size < 2:
        return model
    rng = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(languages)}
    words, labels = _training_sequences(samples, number, rng)
    counts = Counter(zip(words, labels.tolist(), strict=True))
    totals = Counter(words)
    held: dict[str, list[int]] = {}
    for (w, k), n in counts.items():
        if totals[w] >= 2 and 3 * n >= totals[w]:
            held.setdefault(w, []).append(k)
    model.lexicon.update({w: tuple(sorted(ks)) for w, ks in held.items()})
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    slots = [features(w, model.lexicon) for w in distinct]
    ids = np.array([distinct[w] for w in words]).reshape(-1, SEQUENCE)
    labels = labels.reshape(-1, SEQUENCE)
    weights, transitions = model.weights, model.transitions
    square, square_t = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            used, at = np.unique(ids[pick], return_inverse=True)
            at = at.reshape(len(pick), SEQUENCE)
            flat = np.concatenate([slots[u] for u in used])
            lengths = np.array([len(slots[u]) for u in used])
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            scores = np.add.reduceat(weights[flat], begins, axis=0)[at]
            e = np.exp(scores - scores.max(axis=2, keepdims=True))
            t = np.exp(transitions)
            alpha = np.empty_like(e)
            a = np.full((len(pick), size), 1.0 / size)
            for i in range(SEQUENCE):
                a = (a @ t) * e[:, i]
                a /= a.sum(axis=1, keepdims=True)
                alpha[:, i] = a
            beta = np.ones((len(pick), size))
            error = np.empty_like(e)
            pair = np.zeros_like(t)
            for i in range(SEQUENCE - 1, -1, -1):
                m = alpha[:, i] * beta
                error[:, i] = m / m.sum(axis=1, keepdims=True)
                ahead = e[:, i] * beta
                if i:
                    joint = alpha[:, i - 1][:, :, None] * t[None] * ahead[:, None, :]
                    pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                beta = ahead @ t.T
                beta /= beta.sum(axis=1, keepdims=True)
            gold = labels[pick]
            np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) - 1, 2)
            np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            by_word = np.zeros((len(used), size))
            np.add.at(by_word, at.ravel(), error.reshape(-1, size))
            gradient = np.zeros_like(weights)
            np.add.at(gradient, flat, np.repeat(by_word, lengths, axis=0))
            touched = np.unique(flat)
            g = gradient[touched] / len(pick) + DECAY * weights[touched]
            square[touched] += (g * g).mean(axis=1)
            weights[touched] -= RATE * g / np.sqrt(square[touched])[:, None]
            pair /= len(pick)
            square_t += float((pair * pair).mean())
            transitions -= RATE * pair / np.sqrt(square_t)
    model.weights = weights.astype(np.float32)
    return model


class _Slots(dict):
    """Memory of up to three letters, packed by ``_packed`` -> slot of the n-gram that they and a kind make."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def __missing__(self, code: int) -> int:
        letters = (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF)
        name = self.kind + "".join(chr(c) for c in letters if c)
        self[code] = zlib.crc32(name.encode()) % SLOTS
        return self[code]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Slots of codes; each distinct one is looked up once."""
        if len(self) > REMEMBERED:
            self.clear()
        known, place = np.unique(codes, return_inverse=True)
        return np.fromiter(map(self.__getitem__, known.tolist()), np.int64, len(known))[place]


def _packed(letters: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ``sizes`` letters (1 to 3) before each of ``ends`` as one number; no letter is 0."""
    codes = letters[ends - 1].copy()
    for k in (2, 3):
        codes += np.where(sizes >= k, letters[ends - k], 0) << 21 * (k - 1)
    return codes


class Scorer(dict):
    """Memory of word -> row of ``table`` (exponentiated scores); -1 for a run without a letter.

    A new word gets its row at once; the rows of all new words are worked out together by ``fill``.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.size = len(model.languages)
        self.table = np.empty((1024, max(self.size, 1)))
        self.rows = 0
        self.new: list[str] = []
        self.grams, self.heads, self.tails = _Slots(""), _Slots("p"), _Slots("s")

    def __missing__(self, word: str) -> int:
        if not (word.isalpha() or any(c.isalpha() for c in word)):
            self[word] = -1
            return -1
        self[word] = self.rows + len(self.new)
        self.new.append(word)
        return self[word]

    def slots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words' features, word after word in the order of ``features``, and where each word's begin."""
        size = np.array([len(w) for w in words])
        # Two letters before the first word, so that three letters may be taken anywhere.
        letters = np.frombuffer(f"  <{'><'.join(words)}>".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        first = 3 + np.cumsum(size + 2) - (size + 2)
        lexicon = [self.model.lexicon.get(w, ()) for w in words]
        number = 2 * size + 7 + np.array([len(ks) for ks in lexicon])
        begins = np.cumsum(number) - number
        out = np.empty(number.sum(), dtype=np.int64)
        each = lambda count: np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs, triples = each(size + 1), each(size)
        ends = np.concatenate([np.repeat(first + 1, size + 1) + pairs, np.repeat(first + 2, size) + triples])
        places = np.concatenate([np.repeat(begins, size + 1) + pairs, np.repeat(begins + size + 1, size) + triples])
        out[places] = self.grams.of(_packed(letters, ends, np.repeat([2, 3], [len(pairs), len(triples)])))
        for k in (1, 2, 3):
            least = np.minimum(size, k)
            out[begins + 2 * size + k] = self.heads.of(_packed(letters, first + least, least))
            out[begins + 2 * size + 3 + k] = self.tails.of(_packed(letters, first + size, least))
        for at, ks in zip((begins + 2 * size + 7).tolist(), lexicon, strict=True):
            if ks:
                out[at : at + len(ks)] = [zlib.crc32(f"lexicon {k}".encode()) % SLOTS for k in ks]
        return out, begins

    def fill(self) -> None:
        """Work out the rows of the new words, about CHUNK_WORDS at once."""
        for at in range(0, len(self.new), CHUNK_WORDS // 8):
            words = self.new[at : at + CHUNK_WORDS // 8]
            slots, begins = self.slots(words)
            scores = np.add.reduceat(self.model.weights[slots], begins, axis=0)
            while self.rows + len(words) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.rows : self.rows + len(words)] = np.exp(scores - scores.max(axis=1, keepdims=True))
            self.rows += len(words)
        self.new.clear()

    def by_word(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words with a letter, text after text, and how many each text has."""
        if self.rows > REMEMBERED:
            self.clear()
            self.rows = 0
        ids = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        self.fill()
        ids = [i[i >= 0] for i in ids]
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        full = np.flatnonzero(lengths)
        if not len(full) or not self.size:
            return np.zeros((0, self.size)), np.zeros(len(texts), dtype=np.int64)
        return word_marginals([self.table[ids[k]] for k in full], np.exp(self.model.transitions)), lengths

    def summaries(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Mean marginals by language of each text, and the mean of each word's highest one; 0 without letters."""
        words, lengths = self.by_word(texts)
        means, certain = np.zeros((len(texts), self.size)), np.zeros(len(texts))
        full = np.flatnonzero(lengths)
        if len(full):
            at, count = (np.cumsum(lengths) - lengths)[full], lengths[full]
            means[full] = np.add.reduceat(words, at, axis=0) / count[:, None]
            certain[full] = np.add.reduceat(words.max(axis=1), at) / count
        return means, certain

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        """Mean marginals by language of each text (rows sum to 1; 0 without letters)."""
        return self.summaries(texts)[0]


def block_marginals(sequences: list[np.ndarray], t: np.ndarray) -> np.ndarray:
    """Sum of the words' marginals of each sequence of emission rows."""
    lengths = np.array([len(s) for s in sequences])
    return np.add.reduceat(word_marginals(sequences, t), np.cumsum(lengths) - lengths, axis=0)


def word_marginals(sequences: list[np.ndarray], t: np.ndarray) -> np.ndarray:
    """Marginals of all words of non-empty sequences of emission rows, by forward-backward over blocks."""
    size = t.shape[0]
    lengths = np.array([len(s) for s in sequences])
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(sequences)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(len(owner)) - first[owner]
    fill = np.minimum(BLOCK, lengths[owner] - within * BLOCK)
    e = np.ones((len(owner), BLOCK, size))
    flat = np.concatenate(sequences)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    e[np.repeat(first, lengths) + place // BLOCK, place % BLOCK] = flat
    # Longer blocks first, so that the rows still in work at a step are the leading ones.
    order = np.argsort(-fill, kind="stable")
    e, fill_o = e[order], fill[order]
    live = np.array([np.searchsorted(-fill_o, -i, side="left") for i in range(BLOCK)])
    product = np.broadcast_to(np.eye(size), (len(owner), size, size)).copy()
    for i in range(BLOCK):
        k = live[i]
        product[:k] = (product[:k].reshape(-1, size) @ t).reshape(k, size, size) * e[:k, i][:, None, :]
        product[:k] /= product[:k].max(axis=(1, 2), keepdims=True)
    at = np.empty(len(owner), dtype=np.int64)
    at[order] = np.arange(len(owner))
    entering = np.full((len(owner), size), 1.0 / size)
    leaving = np.ones((len(owner), size))
    most = int(blocks.max())
    by_count = np.argsort(-blocks, kind="stable")
    counts = blocks[by_count]
    for b in range(most - 1):
        k = int(np.searchsorted(-counts, -(b + 1), side="left"))
        here = at[first[by_count[:k]] + b]
        v = np.einsum("ni,nij->nj", entering[here], product[here])
        entering[at[first[by_count[:k]] + b + 1]] = v / v.sum(axis=1, keepdims=True)
    for b in range(most - 1, 0, -1):
        k = int(np.searchsorted(-counts, -b, side="left"))
        here = at[first[by_count[:k]] + b]
        v = np.einsum("nij,nj->ni", product[here], leaving[here])
        leaving[at[first[by_count[:k]] + b - 1]] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty_like(e)
    a = entering
    for i in range(BLOCK):
        k = live[i]
        a[:k] = (a[:k] @ t) * e[:k, i]
        a[:k] /= a[:k].sum(axis=1, keepdims=True)
        alpha[:k, i] = a[:k]
    beta = leaving
    for i in range(BLOCK - 1, -1, -1):
        k = live[i]
        m = alpha[:k, i] * beta[:k]
        alpha[:k, i] = m / m.sum(axis=1, keepdims=True)
        beta[:k] = (e[:k, i] * beta[:k]) @ t.T
        beta[:k] /= beta[:k].sum(axis=1, keepdims=True)
    return alpha[at[np.repeat(first, lengths) + place // BLOCK], place % BLOCK]


def training_sample(docs: DataFrame, learn: Column, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(lang, draw, text) of at most ``texts`` labelled rows of each language, those of least hash.

    Only hashes are ranked, first in RANK_PARTS parts of a language and then those left of each, so that a language of
    very many rows is spread and its last ranking bounded; texts are read for the chosen rows alone. Copies of a row
    have one draw, and one text of each is enough.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    marked = labelled.select("lang", "text", F.xxhash64(F.lit(29), "doc_id", "text").alias("draw"))
    ranked = marked.select("lang", "draw").distinct()
    part = F.pmod("draw", F.lit(RANK_PARTS))
    for keys in (["lang", part], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("draw"))).where(F.col("rank") <= texts).drop("rank")
    chosen = marked.join(F.broadcast(ranked.select("lang", "draw")), ["lang", "draw"])
    return chosen.groupBy("lang", "draw").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, learn: Column) -> Model:
    """Model learned from the labelled rows where ``learn`` holds.

    The bounded sample meets in one task, which trains; the driver only gets the model, whose size is fixed but for
    the number of languages.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["lang"], r["draw"]))
        model = train([(r["text"], r["lang"]) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The sample's texts differ in size only within its bound, so one task holds them.
    trained = training_sample(docs, learn).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(trained[0]["model"]) if trained else train([])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, certainty) of every whole text.

    score is the share of lang_pred among the words' marginals; certainty the mean of each word's highest marginal,
    which is high for a text of several languages whose words are told apart. ``und``, 0 and 0 where the text is
    null, has no letter, or nothing was learned.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            start, rows = 0, batch.num_rows
            while start < rows:
                stop, texts, size = start, [], 0
                while stop < rows and size < CHUNK_WORDS:
                    texts.append(words_of(batch.column(1)[stop].as_py()))
                    size += len(texts[-1]) + 1
                    stop += 1
                means, certain = scorer.summaries(texts)
                names = [UNDETERMINED] * len(texts)
                scores = np.zeros(len(texts))
                if scorer.size:
                    best = means.argmax(axis=1)
                    scores = means[np.arange(len(texts)), best]
                    names = [scorer.model.languages[b] if s > 0 else UNDETERMINED for b, s in zip(best, scores, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(names, pa.string()),
                        pa.array(np.minimum(scores, 1.0)),
                        pa.array(np.minimum(certain, 1.0)),
                    ],
                    names=[key, "lang_pred", "score", "certainty"],
                )
                start = stop

    return docs.select(key, text).mapInArrow(run, StructType([docs.schema[key], *_PREDICTED]))


def label_words(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs) of every whole text: runs of neighbouring words of one language, in order.

    A run has start and end (code points of the text, end exclusive), lang, the number of its words, and score, the
    mean of its words' marginals of that language. A word's language is the one of its highest marginal, which
    forward-backward takes over the whole text. No runs where the text is null, has no letter, or nothing was learned.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("score", pa.float64())]))

    def runs_of(text: str | None, scorer: Scorer) -> list[dict]:
        words = [m for m in _WORD.finditer(text or "") if any(c.isalpha() for c in m[0].lower())]
        marginals, _ = scorer.by_word([[m[0].lower() for m in words]])
        if not len(marginals):
            return []
        best = marginals.argmax(axis=1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]]).tolist()
        return [
            {
                "start": words[a].start(),
                "end": words[b - 1].end(),
                "lang": scorer.model.languages[best[a]],
                "words": b - a,
                "score": min(1.0, float(marginals[a:b, best[a]].mean())),
            }
            for a, b in zip(cuts, cuts[1:])
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = pa.array([runs_of(t.as_py(), scorer) for t in batch.column(1)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "runs"])

    field = StructField("runs", ArrayType(_RUN))
    return docs.select(key, text).mapInArrow(run, StructType([docs.schema[key], field]))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every document of (doc_id, text, lang), learned from the rows that are not held out.

    Returns doc_id, held_out, lang_pred, score. Held out are rows whose crc32(doc_id as text) is 1 modulo 3; a null
    doc_id is not. lang, source and doc_id are no inputs of a prediction. Repeated rows are labelled alike;
    an empty table gives no rows; other columns are not read.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    held_out = F.coalesce(remainder == 1, F.lit(False))
    model = fit(docs, ~held_out)
    found = predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose words' languages are found with a certainty of at least ``least``; lang becomes the leading one.

    A text of several languages stays when its words are told apart, whatever their shares. Texts without letters go. The model learns from the labelled rows of ``docs`` themselves; without any, all rows go.
    """
    model = fit(docs, F.lit(True))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text"))
    found = predict(rows, model, "row").where((F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= least))
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
