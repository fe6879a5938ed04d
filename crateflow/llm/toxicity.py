"""Operator 1: toxicity by weak supervision.

Voters: hand-written insult lexicons by language, lexicons mined from labelled texts (word
beginnings and whole words that toxic texts hold far more often), and patterns (shouting,
masked words, rows of exclamation marks, insults in the second person). A voter votes toxic
or abstains; one more votes clean where no lexicon speaks.

A generative label model estimates by expectation-maximisation, from the votes alone and without
any label, how often each voter votes in either class, and from what is left the correlations
between voters given the class. Only voters that vote give evidence, and it is divided by one
plus their correlations with the others that vote, so that voters that repeat each other count
about once. The model's posteriors, never labels, train a linear classifier over the presence of
the lexicons' entries and the patterns; that classifier scores every whole text. Labels of the
fitting rows serve the mining alone.

Mining takes at most ``LABELLED`` labelled texts and keeps the ``ENTRIES`` entries of most toxic
texts; the label model and the classifier take these texts and at most ``UNLABELLED`` others, by a
hash of doc_id.

Null and empty texts hold no entry and get the score of that, near 0. Without labels the
hand-written voters work alone. Texts of any length count whole; repeated rows give repeated
results; an empty table gives an empty one; other columns are left out of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, units

#: Most labelled and other texts to fit on; entries of the mined lexicons, and voters they are dealt to.
LABELLED, UNLABELLED, ENTRIES, MINED_VOTERS = 6000, 3000, 1024, 16
#: A mined entry has at most one clean text in this many toxic ones, and the chance that as many
#: texts were all toxic by accident is below this.
PURITY, ACCIDENT = 100, 1e-7
#: A mined entry of this many toxic texts and no clean one goes to the strong voters.
STRONG = 10
EPOCHS, STEP, DECAY = 300, 0.1, 1e-3
_WORD = re.compile(r"[^\W\d_]+")
#: Insults by language.
LEXICONS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb imbecile retard bastard bitch asshole fuck fucking shit cunt whore slut freak filth vermin".split(),
    "de": "idiot idioten trottel dumm dummkopf arschloch scheiße schwein hure abschaum versager hurensohn wichser missgeburt".split(),
    "fr": "idiot idiote imbécile connard connasse salaud salope merde pute ordure crétin débile abruti enculé".split(),
    "es": "idiota imbécil estúpido estúpida mierda puta cabrón pendejo basura escoria gilipollas maricón".split(),
    "it": "idiota stupido stupida stronzo stronza merda puttana bastardo coglione deficiente feccia cretino".split(),
    "pt": "idiota imbecil estúpido burro merda puta lixo otário desgraçado vagabundo babaca escória".split(),
    "contempt": "subhuman parasite parasites cockroach cockroaches maggot maggots garbage worthless braindead disgrace untermensch ungeziefer sous-homme vermine parásito escoria".split(),
    "threat": "strangle stab gutted beheaded lynch exterminate umbringen abstechen erwürgen égorger étrangler matar degollar".split(),
}
#: Patterns of toxic texts.
PATTERNS = [
    re.compile(r"!{3,}"),
    re.compile(r"\b[a-z]\*{2,}[a-z]*\b", re.I),
    re.compile(r"\byou(?:'re| are)? (?:an? |such an? )?(?:total |complete |absolute )?(?:idiot|moron|loser|clown|disgrace|failure|pig|rat)\b", re.I),
    re.compile(r"\b(?:kill|hate|hurt) (?:you|yourself|them all)\b", re.I),
    re.compile(r"\b(?:shut up|get lost|go to hell|drop dead)\b", re.I),
    re.compile(r"\b(?:i|we)(?:'ll| will| am going to| are going to) (?:find|hurt|kill|end|destroy) (?:you|them)\b", re.I),
    re.compile(r"\b(?:nobody|no one) (?:likes|loves|wants|needs) you\b", re.I),
    re.compile(r"\b(?:die|rot|burn) in (?:hell|a fire)\b", re.I),
    re.compile(r"\b(?:du|ihr) (?:bist|seid) (?:ein |eine |so )?(?:dumm|idiot|versager|abschaum|trottel)\w*\b", re.I),
    re.compile(r"\b(?:tu es|t'es|vous êtes) (?:un |une |des )?(?:idiot|con|connard|débile|nul)\w*\b", re.I),
    re.compile(r"\beres (?:un |una )?(?:idiota|imbécil|estúpid[oa]|basura)\b", re.I),
    re.compile(r"\b(?:halt die fresse|ferme ta gueule|cállate la boca|sta' zitto)\b", re.I),
    re.compile(r"\b[a-z]*[@$#0][a-z]*(?:hole|tch|ck|unt)\b", re.I),
]
#: What a text in lower case must hold (any of these) for each pattern to match; it is looked for first.
NEEDED = [
    ("!!!",), ("**",), ("you",), ("kill you", "kill them", "hate you", "hate them", "hurt you", "hurt them"), ("shut up", "get lost", "go to hell", "drop dead"),
    ("find you", "find them", "hurt you", "hurt them", "kill you", "kill them", "end you", "end them", "destroy you", "destroy them"), ("nobody ", "no one "),
    (" in hell", " in a fire"), ("du bist ", "du seid ", "ihr bist ", "ihr seid "), ("tu es ", "t'es ", "vous êtes "), ("eres ",),
    ("halt die fresse", "ferme ta gueule", "cállate la boca", "sta' zitto"), ("@", "$", "#", "0"),
]
#: Letters that match an ASCII one whatever its case and do not become it in lower case.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")


def patterns_in(text: str, lower: str) -> list[int]:
    """The numbers of the patterns that match a text."""
    odd = _ODD_CASE.search(text) is not None
    return [k for k, (p, needed) in enumerate(zip(PATTERNS, NEEDED, strict=True)) if (odd or any(n in lower for n in needed)) and p.search(text)]


def word_features(word: str) -> list[str]:
    """A word's beginnings of four to eight letters, and the word as a whole."""
    return [word[:n] for n in range(4, 9) if len(word) > n] + [word + "$"]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Lexicon:
    """The entries that count, and what each word holds of them."""

    def __init__(self, mined: list[tuple[str, bool]]):
        hand = {w + "$" for words in LEXICONS.values() for w in words}
        self.entries = sorted(hand | {e for e, _ in mined})
        self.index = {e: i for i, e in enumerate(self.entries)}
        groups: dict[str, set[int]] = {k: {self.index[w + "$"] for w in words} for k, words in LEXICONS.items()}
        for e, strong in mined:  # a family of beginnings stays with one voter
            groups.setdefault(f"mined {strong} {sum(e[:4].encode()) % MINED_VOTERS}", set()).add(self.index[e])
        self.voters = [np.array(sorted(g)) for _, g in sorted(groups.items())]
        self.memory: units.Memory | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": None}

    def find(self, text: str | None) -> list[int]:
        """Entries a text holds, then patterns, as sorted numbers."""
        if self.memory is None:
            self.memory = units.Memory(200_000)
        if not text:
            return []
        out: set[int] = set()
        lower = text.lower()
        for w in set(_WORD.findall(lower)):
            own = self.memory.get(w)
            if own is None:
                own = tuple(self.index[f] for f in word_features(w) if f in self.index)
                self.memory.put(w, own)
            if own:
                out.update(own)
        out.update(len(self.entries) + k for k in patterns_in(text, lower))
        return sorted(out)

    @property
    def width(self) -> int:
        return len(self.entries) + len(PATTERNS)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """texts x voters: 1 toxic, -1 clean, 0 abstains."""
        out = [x[:, v].any(axis=1) if len(v) else np.zeros(len(x), bool) for v in self.voters]
        out += [x[:, len(self.entries) + k] > 0 for k in range(len(PATTERNS))]
        lexical = np.stack(out[: len(self.voters)], axis=1).any(axis=1)
        return np.column_stack([*[o.astype(int) for o in out], np.where(lexical, 0, -1)])


def label_model(votes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, each voter's chance to vote by class, correlations given the class)."""
    spoke = (votes != 0).astype(float)
    post = np.where(spoke[:, :-1].any(axis=1), 0.7, 0.02)
    relation = np.eye(votes.shape[1])
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        chance = (weight @ spoke + 0.5) / (weight.sum(axis=1, keepdims=True) + 1)
        prior = np.clip(post.mean(), 0.005, 0.995)
        strong = np.where(np.abs(relation) > 0.1, np.abs(relation), 0.0)
        np.fill_diagonal(strong, 0)
        part = spoke / (1 + spoke @ strong)
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + part @ np.log(chance[1] / chance[0]), -30, 30)))
        rest = spoke - (chance[0][None, :] + np.outer(post, chance[1] - chance[0]))
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        relation = (rest.T @ rest) / len(rest) / np.outer(scale, scale)
    return post, chance, relation


def fit_linear(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias. Classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.clip(target.mean(), 0.01, 0.99)
    weight = target / share + (1 - target) / (1 - share)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) / len(x) + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        own = [self.lexicon.find(t) for t in texts]
        at = np.repeat(np.arange(len(own)), [len(f) for f in own])
        z = np.bincount(at, weights=self.weights[np.fromiter((k for f in own for k in f), dtype=np.int64, count=len(at))], minlength=len(own)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def mine(texts: DataFrame) -> list[tuple[str, bool]]:
    """(entry, strong) for the mined lexicons from texts (doc_id, text, toxic), counted by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[y].update({f for w in _words(t) for f in word_features(w)})
        names = [f for f in seen[1]] + [f for f in seen[0] if f not in seen[1]]
        for k in range(0, len(names), 20_000):
            own = names[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([seen[1][f] for f in own], pa.int64()), pa.array([seen[0][f] for f in own], pa.int64())], names=["entry", "toxic", "clean"])

    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not size.get(1) or not size.get(0):
        return []
    found = texts.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    support = np.log(ACCIDENT) / np.log(size[1] / (size[0] + size[1]))
    best = found.where((F.col("toxic") >= float(support)) & (F.col("clean") * PURITY <= F.col("toxic"))).orderBy(F.desc("toxic"), "entry").limit(ENTRIES)
    return sorted((r.entry, r.toxic >= STRONG and not r.clean) for r in best.collect())


def fit_arrays(lexicon: Lexicon, found: list[list[int]]) -> Model:
    """The label model and the classifier from what each fitting text holds."""
    x = np.zeros((len(found), lexicon.width), dtype=np.float32)
    for row, own in zip(x, found, strict=True):
        row[own] = 1
    if not len(x):
        return Model(lexicon, np.append(np.full(lexicon.width, 2.0), -3.0))
    post, _, _ = label_model(lexicon.votes(x))
    return Model(lexicon, fit_linear(x, post))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) outside the held-out fold."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (sampling.fold(modulus) != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = sampling.with_text(docs, sampling.first_by_hash(usable, LABELLED)).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")
    others = sampling.first_by_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(sampling.fold(modulus) != held_out), UNLABELLED)
    unlabelled = sampling.with_text(docs, others.distinct()).select("doc_id", "text", F.lit(-1).alias("toxic"))
    kept = common.stored(labelled, "toxicity-sample")  # read twice
    lexicon = Lexicon(mine(kept))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [lexicon.find(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "found"])

    rows = kept.union(unlabelled).mapInArrow(find, "doc_id long, found array<int>").collect()  # bounded by the two limits
    return fit_arrays(lexicon, sorted(list(r.found) for r in rows))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of entries

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.scores(texts), pa.float64())], names=["doc_id", "score"])

    return common.texts_of(docs).mapInArrow(work, "doc_id long, score double")
