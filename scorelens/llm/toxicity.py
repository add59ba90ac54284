"""Toxicity by weak supervision.

Voters answer for, against or not at all:

- lexicons written down here, by language and kind of insult, and patterns written down here
  (insults that are spelt with signs, stretched, in capitals, or aimed at the reader) are for a
  text or silent;
- prefix patterns induced from labelled rows, for languages and words without a list: the
  word beginnings that cover the most toxic rows not covered yet, while nearly all rows that
  have them are toxic and LEAST_SUPPORT more rows are covered.  They are for a text or silent; a
  beginning counts only where one in DENSE distinct words has it;
- quiet voters: for each language, against texts in it (as function words show) in which no
  lexicon or written pattern is found; and one against texts in which no voter finds anything.

A generative label model sees the votes alone and no label.  It treats the class as hidden and
estimates, for each voter, how often it is for and against in either class, and the
correlations of voters inside the classes, by which voters that say the same are weakened.  A
linear classifier over the voters' hits is trained on its posterior labels.  Given labels serve
to induce prefixes (one part of the training rows) and to calibrate the score (the other).

Only ``sample`` labelled documents, chosen by the hash of their ids, are used to fit; held-out
rows (see ``common.held_out``) never are.  Of training documents that share their smallest
hash of five-word shingles one counts, as copies would make all their words look toxic.

Defined cases: a null or empty text has no hits and gets the score that belongs to none; the words of
a very long text are gathered in parts; labels that are null, or of no document, are not used, and of an
id's labels the largest counts; without labels of both classes every score is the share of toxic
labels (0 without any); equal texts get equal scores; repeated rows give repeated rows; an empty
table gives an empty result; further columns are carried along by ``drop_toxic`` whatever their
names, and left out by ``toxicity``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out

SAMPLE = 12_000
STEMS = (4, 5, 6)
LEAST_SUPPORT = 4
#: Of the rows with an induced prefix, the share that is toxic at least; prefixes at most.
PURITY, INDUCED = 0.9, 200
#: Words and beginnings that are pure enough and may be induced; the commonest.
CANDIDATES = 2_000
#: Distinct words from which a voter speaks against a text, function words of a language, and
#: distinct words of a text for one that has an induced beginning.
SPOKEN, FUNCTION, DENSE = 12, 3, 100
#: How sure a voter that is for a row is taken to be.
BELIEF = 0.95
#: Characters of a text that are read at once.
PART = 1 << 20
WORD = re.compile(r"[^\W\d_]+")

#: Lexicons: language, then kind.  Words that are common in another sense or language are left out.
LEXICONS = {
    "en": {
        "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin dimwit halfwit nitwit brainless braindead simpleton retard retarded dunce",
        "worth": "worthless pathetic loser losers useless failure wretch wretched nobody spineless coward cowardly parasite leech waster deadbeat",
        "dirt": "trash garbage scum scumbag filthy vermin swine sewage dirtbag sleazebag maggot",
        "disgust": "disgusting revolting repulsive nauseating sickening despicable loathsome hideous",
        "mockery": "clown clowns buffoon freak weirdo creep creepy laughable ridiculous dork douche douchebag crybaby",
        "abuse": "bastard bastards bitches asshole assholes arsehole wanker prick slut whore crappy bullshit fuck fucking fucker shitty",
    },
    "fr": {"insult": "idiot idiote idiots imbécile imbéciles crétin crétine débile abruti abrutie connard connasse salaud salope ordure minable minables pourriture dégoûtant dégoûtante racaille bouffon merde putain"},
    "de": {"insult": "idiot idioten vollidiot trottel dummkopf depp arschloch abschaum versager widerlich ekelhaft wertlos erbärmlich drecksack miststück schwachkopf scheiße dumm blöd"},
    "es": {"insult": "idiota idiotas imbécil imbéciles estúpido estúpida basura asqueroso asquerosa inútil inútiles escoria payaso payasa patético patética perdedor perdedora cabrón mierda puta tonto"},
}
#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that with for was on are as it this be",
    "fr": "le la les des et dans pour que est une du au sur par",
    "de": "der die und das den ist nicht mit von dem auf für sich ein",
    "es": "el los las del que en por una con para su es al",
}
#: Patterns over a whole text.  Signs and digits in the place of letters; letters three times;
#: capitals; threats; the reader addressed.
PATTERNS = {
    "masked": r"(?i)(?<!\w)(?=\w*[0-9!*@])(?:[i1!]d[i1!*][o0*][t7]|m[o0*]r[o0*]n|st[u*]p[i1!*]d|l[o0*]s[e3*]r|[t7]r[a@4*]sh|f[u*]ck|sh[i1!*]t|b[i1!*]tch)(?!\w)",
    "stretched": r"(?i)(?<!\w)(?:idi+o{3,}t|mor+o{3,}n|stu{3,}pid|lo{3,}ser|tra{3,}sh|pathe{3,}tic)(?!\w)",
    "capitals": r"(?<!\w)(?:IDIOTS?|MORONS?|STUPID|LOSERS?|TRASH|SCUM|PATHETIC|WORTHLESS|DISGUSTING|CLOWNS?|GARBAGE)(?!\w)",
    "threat": r"(?i)(?<!\w)(?:kill yourself|drop dead|i(?:'ll| will) (?:kill|hurt|beat) you|hope you die)(?!\w)",
    "aimed": r"(?i)(?<!\w)you(?:'re| are|r)?(?: \w+){0,2} (?:idiots?|morons?|stupid|losers?|trash|scum|pathetic|worthless|disgusting|clowns?|garbage|useless)(?!\w)",
}
#: Patterns of which every match holds a word of a lexicon.
PLAIN = ("capitals", "aimed")


def parts(text: str) -> Iterator[str]:
    """A text in parts of about PART characters, cut after white space."""
    at = 0
    while len(text) - at > PART:
        end = next((k for k in range(at + PART, at, -1) if text[k].isspace()), at + PART)
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case."""
    return set().union(*(WORD.findall(p.lower()) for p in parts(text or "")))


def stems_of(words: set[str], of: int | None = None) -> dict[str, int]:
    """Beginnings of words, followed by '*', that enough of ``of`` words have, with their number."""
    once = Counter(w[:n] + "*" for w in words for n in STEMS if len(w) > n)
    return {x: n for x, n in once.items() if n * DENSE >= (of or len(words))}


@dataclass
class Voters:
    """All voters: written lexicons, written patterns, induced prefixes, quiet ones."""

    induced: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lexicons = [frozenset(words.split()) for kinds in LEXICONS.values() for words in kinds.values()]
        self.function = [frozenset(w.split()) for w in FUNCTION_WORDS.values()]
        self.known = frozenset().union(*self.lexicons)
        self.patterns = [(name, re.compile(p)) for name, p in PATTERNS.items()]
        self.written = len(self.lexicons) + len(self.patterns)
        self.place = {f: self.written + k for k, f in enumerate(self.induced)}
        self.prefixes = tuple(f[:-1] for f in self.induced if f[-1] == "*")

    def of_patterns(self, text: str | None, words: set[str]) -> list[int]:
        """Matches of each pattern.  Those of whole words of a lexicon need one among ``words``."""
        plain = bool(words & self.known)
        return [sum(1 for _ in p.finditer(text or "")) if plain or name not in PLAIN else 0 for name, p in self.patterns]

    def hits(self, words: set[str], stems: dict[str, int], of_patterns: list[int]) -> np.ndarray:
        """What each voter that can be for a text finds: distinct words of a lexicon or with a
        prefix, and matches of a pattern."""
        out = np.zeros(self.written + len(self.induced))
        out[: len(self.lexicons)] = [len(words & own) for own in self.lexicons]
        out[len(self.lexicons) : self.written] = of_patterns
        for f in (self.place.keys() & words) | (self.place.keys() & stems.keys()):
            out[self.place[f]] = stems.get(f, 1)
        return out

    def stems(self, words: set[str]) -> dict[str, int]:
        """What ``stems_of`` gives, of induced beginnings only."""
        return stems_of({w for w in words if w.startswith(self.prefixes)}, len(words)) if self.prefixes else {}

    def votes(self, words: set[str], hits: np.ndarray) -> np.ndarray:
        """1 for, -1 against, 0 neither; those of quiet voters last."""
        long, plain = len(words) >= SPOKEN, not hits[: self.written].any()
        quiet = [long and plain and len(words & own) >= FUNCTION for own in self.function] + [long and not hits.any()]
        return np.concatenate(((hits > 0).astype(np.int8), -np.array(quiet, np.int8)))


@dataclass
class Model:
    """weights: bias, one per voter, all hits; curve: bias and slope of the calibration."""

    voters: Voters
    weights: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 0)))

    def logit(self, hits: np.ndarray) -> np.ndarray:
        return inputs(hits) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 1 / (1 + np.exp(-self.curve[0])))
        hits = np.zeros((len(texts), self.voters.written + len(self.voters.induced)))
        for row, text in zip(hits, texts, strict=True):
            words = words_of(text)
            row[:] = self.voters.hits(words, self.voters.stems(words), self.voters.of_patterns(text, words))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.logit(hits), -30, 30)))


def inputs(hits: np.ndarray) -> np.ndarray:
    """Bias, the logarithm of each voter's hits, and that of all."""
    return np.hstack((np.ones((len(hits), 1)), np.log1p(hits), np.log1p(hits.sum(1, keepdims=True))))


def label_model(votes: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates, correlations) from votes of 1, -1 and 0.  rates[j]: the share of rows
    that voter j answers, in class 0 and in class 1 (its answers are taken to be right no less
    often than by chance); correlations[c]: of the votes inside class c.

    Expectation and maximisation.  What is believed before (a row that any voter is for is of
    class 1 with BELIEF) has half the say in each estimate, as a voter that is alone in its rows
    tells nothing about itself.  No answer says nothing.
    An answer's weight falls with those of other voters for the same row that are alike and
    correlated with it.
    """
    n, m = votes.shape
    v, sign = votes.astype(float), np.where((votes < 0).any(0), -1.0, 1.0)
    said = np.abs(v)
    before, rates, corr = np.where((votes > 0).any(1), BELIEF, 1 - BELIEF), np.zeros((m, 2)), np.zeros((2, m, m))
    post = before
    for _ in range(rounds):
        belief = (post + before) / 2
        for c, p in enumerate((1 - belief, belief)):
            total = p.sum() + 1e-9
            rates[:, c] = (p @ said + 0.5) / (total + 1)
            apart = said - rates[:, c]
            cov = (apart * p[:, None]).T @ apart / total
            dev = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            corr[c] = cov / dev / dev[:, None]
        alike = np.clip(corr.mean(0), 0, 1) * (1 - np.eye(m)) * (sign[:, None] == sign)
        odds = sign * np.maximum(0, sign * np.log(rates[:, 1] / rates[:, 0]))
        share = np.clip(post.mean(), 0.001, 0.5)
        post = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + (said / (1 + said @ alike)) @ odds, -30, 30)))
    return post, rates, corr


def induce(toxic: list[set[str]], good: dict[str, int]) -> list[str]:
    """Of ``good`` (words and beginnings, with the toxic rows that have them) those that cover
    ``toxic`` rows, the most rows not covered yet first."""
    where = defaultdict(set)
    for k, f in enumerate(toxic):
        for x in f & good.keys():
            where[x].add(k)
    out: list[str] = []
    while where and len(out) < INDUCED:
        # Of equal covers the longer beginning, which says more, then the first by name.
        best = max(where, key=lambda x: (len(where[x]), good[x], len(x), x))
        if len(where[best]) < LEAST_SUPPORT:
            break
        out.append(best)
        done = set(where[best])
        where = {x: left for x, own in where.items() if (left := own - done)}
    return out


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps; the bias is free."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """doc_id, text, y of about ``sample`` labelled rows that are not held out."""
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("y_id"), F.col(label_col).cast("int").alias("y")).where(~held_out("y_id"))
    y = y.groupBy("y_id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(1, y.count()))
    chosen = y.where(F.pmod(F.xxhash64("y_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("y_id")).drop("y_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The driver gets the votes of at most ``sample`` rows, and of the toxic ones that no lexicon
    covers which of at most CANDIDATES words and beginnings they have."""
    written = Voters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for doc_id, text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = (text or "").encode().lower().split()
                sign = min(xxhash.xxh3_64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))) >> 1
                words = words_of(text)
                hits = written.hits(words, {}, written.of_patterns(text, words))
                out.append((doc_id, y, sign, sorted(words | stems_of(words).keys()), hits.astype(int).tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "y", "sign", "f", "hits"])

    rows = training_rows(docs, labels, label_col, id_col, text_col, sample).mapInArrow(run, "doc_id long, y int, sign long, f array<string>, hits array<int>")
    rows = cut(rows.withColumn("nth", F.row_number().over(Window.partitionBy("sign", "y").orderBy("doc_id"))).where("nth = 1").drop("nth", "sign"))
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        share = min(max(n.get(1, 0) / max(1, sum(n.values())), 1e-9), 1 - 1e-9) if n else 1e-9
        return Model(written, np.zeros(0), np.array([np.log(share / (1 - share)), 1.0]))
    first = rows.withColumn("first", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0)
    counted = first.where("first").select("y", F.explode("f").alias("x")).groupBy("x").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n"))
    good = {r.x: r.good for r in counted.where((F.col("good") >= LEAST_SUPPORT) & (F.col("good") >= PURITY * F.col("n"))).orderBy(F.desc("good"), "x").limit(CANDIDATES).collect()}
    known = F.array(*map(F.lit, sorted(written.known)))
    pure = F.array(*map(F.lit, sorted(good))) if good else F.array().cast("array<string>")
    uncovered = first.where(F.col("first") & (F.col("y") == 1) & ~F.arrays_overlap("f", known)).orderBy("doc_id").select(F.array_intersect("f", pure).alias("f"))
    voters = Voters(induce([set(r.f) for r in uncovered.collect()], good))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, known = (c.to_pylist() for c in b.columns)
            words = [{x for x in w if x[-1] != "*"} for w in words]
            hits = [voters.hits(w, voters.stems(w), k[len(written.lexicons) :]) for w, k in zip(words, known, strict=True)]
            votes = [voters.votes(w, h).tolist() for w, h in zip(words, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([h.astype(int).tolist() for h in hits], pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32()))], names=["doc_id", "hits", "votes"])

    every = rows.select("doc_id", "f", "hits").mapInArrow(again, "doc_id long, hits array<int>, votes array<int>")
    got = first.select("doc_id", "y", "first").join(every, "doc_id").orderBy("doc_id").toArrow()
    hits, votes = (np.array(got[k].combine_chunks().flatten().to_numpy(), dtype=float).reshape(len(got), -1) for k in ("hits", "votes"))
    post, rates, correlations = label_model(votes)
    model = Model(voters, linear(inputs(hits), post), rates=rates, correlations=correlations)
    rest, y = ~got["first"].to_numpy(zero_copy_only=False).astype(bool), got["y"].to_numpy().astype(float)
    if 0 < y[rest].sum() < rest.sum():
        z = model.logit(hits[rest])
        model.curve = linear(np.stack((np.ones(len(z)), z), 1), y[rest], penalty=0.01)
        if model.curve[1] <= 0:
            model.curve = np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column of scores; only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(texts.tolist()))

    return docs.withColumn(to, scores(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, labels, id_col, text_col, **options))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; its rows travel in one struct,
    so that no name of theirs can meet one used here."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score(rows, fit(docs, labels, id_col, text_col, **options)).where(F.col("score") < threshold).select("row.*")
