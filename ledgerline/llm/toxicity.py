"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

The lexicon holds whole words and stems that labelled toxic texts have and clean ones lack. A word
of a text is intersected with the trie of the lexicon by the word's Levenshtein automaton, so that
misspelled terms count as well. A window of words around each hit tells abuse from quotation, and
the hits of a text go through a logistic calibration to a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import logistic
from ledgerline.llm.common import drop_stored, fold, sampled, stored, table

THRESHOLD = 0.5
#: Bounds of the labelled sample, in documents.
TOXIC_DOCS, CLEAN_DOCS = 3000, 12000
#: Least hashes of five-word shingles that copies, which count once, have in common.
COPY_HASHES = 5
#: Letters of a stem, and of a whole word from which one edit is allowed.
STEM, FUZZY_FROM = (4, 5, 6, 7, 8), 5
#: Share of labelled texts with a term that must be toxic.
PRECISION = 0.95
#: Words on either side of a hit that its context has.
WINDOW = 6
#: Tokens that one of the two generations of a matcher's memory holds.
CACHE = 100_000
#: Words that report speech, and words that address the reader, in the corpus's four languages.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms slur insult sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your yourself du dich dir dein ihr euch tu toi ton vous votre tú ti eres usted".split())
_OPEN, _CLOSE = "\"“”„«»‹›‘", "\"“”«»‹›’"
_WORD = re.compile(r"\w+")
#: Characters that stand for letters.
_LEET = str.maketrans("013457@$!", "oleastasi")


class Trie:
    """Terms as a trie; ``search`` walks it with a word's Levenshtein automaton.

    A state of the automaton is the row of edit distances between the path so far and each prefix
    of the word; a branch ends when all entries exceed the limit.
    """

    def __init__(self, terms: dict[str, bool]):
        """terms: term -> is it a stem, which matches as a prefix."""
        self.root: dict = {}
        for term, stem in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, stem)

    def search(self, word: str, limit: int) -> tuple[str, int] | None:
        """The closest term within ``limit`` edits (ties: the first by name), with its distance."""
        best: list[tuple[int, str]] = []
        todo = [(self.root, tuple(range(len(word) + 1)))]
        while todo:
            node, row = todo.pop()
            for c, below in node.items():
                if c == "":
                    term, stem = below
                    distance = min(row) if stem else row[-1]
                    if distance <= limit:
                        best.append((distance, term))
                    continue
                after = [row[0] + 1]
                for j, x in enumerate(word, 1):
                    after.append(min(after[-1] + 1, row[j] + 1, row[j - 1] + (c != x)))
                if min(after) <= limit:
                    todo.append((below, tuple(after)))
        return min(best)[::-1] if best else None


def _shorter(word: str) -> Iterator[str]:
    """The word and what is left without one of its characters: two words within one edit share one of these."""
    yield word
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


@dataclass(frozen=True)
class Model:
    """terms: term -> is it a stem. fuzzy: terms for which misspellings count. weights: None without labelled texts."""

    terms: dict[str, bool]
    fuzzy: frozenset[str]
    weights: tuple[float, ...]


@dataclass
class Matcher:
    """What a token of a text means, remembered for the tokens seen last."""

    model: Model
    seen: dict[str, tuple[str, int] | None] = field(default_factory=dict)
    before: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        stems = [t for t, stem in self.model.terms.items() if stem]
        self.whole = {t for t, stem in self.model.terms.items() if not stem}
        self.stems = frozenset(stems)
        self.lengths = sorted({len(t) for t in stems})
        fuzzy = {t: self.model.terms[t] for t in self.model.fuzzy}
        self.trie = Trie(fuzzy)
        self.near = frozenset(s for t in fuzzy for s in _shorter(t))
        #: No word longer than this is within one edit of a whole term, and no stem looks further into a word.
        self.longest = max(map(len, fuzzy), default=0) + 1
        self.fuzzy_stems = sorted({n for t, stem in fuzzy.items() if stem for n in (len(t) - 1, len(t), len(t) + 1)})

    def word(self, word: str) -> tuple[str, int] | None:
        if word in self.whole:
            return word, 0
        for n in self.lengths:
            if word[:n] in self.stems and len(word) >= n:
                return word[:n], 0
        if len(word) < FUZZY_FROM - 1 or not self.near:
            return None
        # a term within one edit of the word, or of one of its prefixes, shares a shortened form with it
        whole = len(word) <= self.longest and not self.near.isdisjoint(_shorter(word))
        if whole or any(not self.near.isdisjoint(_shorter(word[:n])) for n in self.fuzzy_stems if n < len(word)):
            return self.trie.search(word[: self.longest + 1], 1)  # what follows makes no term closer
        return None

    def token(self, token: str) -> tuple[str, int] | None:
        """The best hit among the words of a white-space token, or of the token with look-alike characters replaced."""
        found = [x for x in map(self.word, _WORD.findall(token)) if x]
        if not found and not token.isalpha():
            bare = token.strip(".,;:?()[]{}\"'“”„«»‹›‘’")
            plain = bare.translate(_LEET)
            if plain != bare and plain.isalpha() and (hit := self.word(plain)):
                found = [(hit[0], hit[1] + 1)]
        return min(found, key=lambda x: x[1]) if found else None

    def hits(self, text: str | None) -> list[tuple[str, int, float]]:
        """(term, distance, quoted in 0..1) of each hit of the whole text."""
        tokens = (text or "").lower().split()
        if len(self.seen) > CACHE:
            self.seen, self.before = {}, self.seen
        seen, before = self.seen, self.before
        for t in set(tokens).difference(seen):
            seen[t] = before[t] if t in before else self.token(t)
        at = [i for i, hit in enumerate(map(seen.__getitem__, tokens)) if hit]
        return [(*seen[tokens[i]], quoted(tokens, i)) for i in at]


def quoted(tokens: list[str], at: int) -> float:
    """How likely the token at ``at`` is quoted: quotation marks around it and a reporting word before it, less an address to the reader."""
    before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    opened = any(t[0] in _OPEN and not (len(t) > 1 and t.rstrip(".,;:!?")[-1:] in _CLOSE) for t in before) or tokens[at][0] in _OPEN
    closed = any(t.rstrip(".,;:!?")[-1:] in _CLOSE for t in after) or tokens[at].rstrip(".,;:!?")[-1:] in _CLOSE
    reported = any(t.strip(".,;:!?\"'“”„«»") in REPORTING for t in before)
    address = any(t.strip(".,;:!?\"'“”„«»") in ADDRESS for t in before + after)
    return min(1.0, max(0.0, 0.6 * (opened and closed) + 0.4 * reported - 0.3 * address))


def features(hits: list[tuple[str, int, float]]) -> list[float]:
    """Constant; abusive hits and quoted hits, each as log(1 + their sum). A misspelled hit counts MISSPELLED of an exact one."""
    abuse = sum((1 - q) * (MISSPELLED if d else 1.0) for _, d, q in hits)
    return [1.0, np.log1p(abuse), np.log1p(sum(q for _, _, q in hits))]


MISSPELLED = 0.9
#: What is believed before any labelled text: a single abusive hit suffices, a quoted one doesn't.
PRIOR = np.array([-4.0, 8.0, 1.5])


def _forms(text: str) -> set[str]:
    """Words of a text as "word", and their prefixes as "pre-"."""
    words = {w for w in _WORD.findall((text or "").lower()) if len(w) >= STEM[0] and not w.isdigit()}
    return words | {w[:n] + "-" for w in words for n in STEM if len(w) > n}


def _counted(rows: DataFrame) -> DataFrame:
    """(form, n): texts that hold each form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text in batch.column(0):
                total.update(_forms(text.as_py()))
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["form", "n"])

    return rows.select("text").mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def once(rows: DataFrame) -> DataFrame:
    """(text, y) of labelled rows with copies of one label counted once: the least text of those whose COPY_HASHES least hashes of five-word shingles are equal.

    Texts of different labels never merge. A text that shares a passage with others has a hash of its own
    among its least ones unless nearly all of it is the passage.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(F.slice(F.col("w"), i + 1, 5)))
    rows = rows.withColumn("w", words).select("text", "y", F.slice(F.array_sort(F.array_distinct(shingles)), 1, COPY_HASHES).alias("copy"))
    return rows.groupBy("y", "copy").agg(F.min("text").alias("text")).select("text", "y")


def choose_terms(held: list[set[str]], clean: dict[str, int], n_clean: int) -> dict[str, bool]:
    """Terms -> is it a stem, from the candidate forms of each toxic text and the forms' counts in clean texts.

    First every sure form that at least 2 % of the toxic texts hold (8 at least); of forms of one
    family, the longest that holds nearly as many. Then a greedy cover of the toxic texts without
    a term so far; each term must cover some that no other does, so that the words of a text which
    was copied many times are not taken for toxic ones.
    """
    by_form: dict[str, set[int]] = {}
    for i, forms in enumerate(held):
        for f in forms:
            by_form.setdefault(f, set()).add(i)
    scale = max(1.0, n_clean / max(1, len(held)))
    sure = {f: rows for f, rows in by_form.items() if len(rows) * scale >= PRECISION * (len(rows) * scale + clean.get(f, 0))}
    order = lambda f: (len(sure[f]), len(f.rstrip("-")), not f.endswith("-"), f)
    terms: dict[str, bool] = {}
    strong = sorted((f for f in sure if len(sure[f]) >= max(8, len(held) // 50)), key=order, reverse=True)
    for f in strong:
        name = f.rstrip("-")
        longer = any(g != f and len(g.rstrip("-")) >= len(name) and g.startswith(name) and len(sure[g]) >= 0.95 * len(sure[f]) and order(g)[1:] > order(f)[1:] for g in strong)
        known = any(stem and name.startswith(t) or f.endswith("-") and t.startswith(name) and sure[f] <= sure.get(t + "-" * stem, set()) for t, stem in terms.items())
        if not longer and not known:
            terms[name] = f.endswith("-")
    left = set(range(len(held))).difference(*(sure[t + "-" * stem] for t, stem in terms.items()))
    least = max(3, len(held) // 500)
    open_ = {f: rest for f, rows in sure.items() if len(rest := rows & left) >= least}
    while open_:
        best = max(open_, key=lambda f: (len(open_[f]), *order(f)[1:]))
        terms[best.rstrip("-")] = best.endswith("-")
        gone = open_[best]
        open_ = {f: rest for f, rows in open_.items() if len(rest := rows - gone) >= least}
    return terms


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn terms and weights from a bounded sample of labelled rows outside fold 0; copies count once.

    A doc_id with several labels counts as toxic; null labels and ids play no part.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    both = sampled(known.where("y = 1"), "doc_id", TOXIC_DOCS).unionByName(sampled(known.where("y = 0"), "doc_id", CLEAN_DOCS))
    rows = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").where("text IS NOT NULL")
    rows = stored(once(rows), "labelled")
    toxic, clean_rows = rows.where("y = 1"), rows.where("y = 0")
    n_toxic, n_clean = toxic.count(), clean_rows.count()
    least = max(2, n_toxic // 500)
    scale = max(1.0, n_clean / max(1, n_toxic))
    often = _counted(toxic).where(F.col("n") >= least)
    counted = often.join(_counted(clean_rows).withColumnRenamed("n", "clean"), "form", "left").fillna(0, ["clean"])
    # only sure forms are gathered; choose_terms asks the same again of the texts that it gets
    sure = counted.where(F.col("n") * scale >= PRECISION * (F.col("n") * scale + F.col("clean"))).collect()
    clean = {r.form: r.clean for r in sure}
    wanted = set(clean)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([sorted(_forms(x.as_py()) & wanted) for x in batch.column(0)], pa.list_(pa.string()))], ["forms"])

    terms = choose_terms([set(r.forms) for r in toxic.select("text").mapInArrow(held, "forms array<string>").collect()], clean, n_clean)
    draft = Model(terms, frozenset(t for t in terms if len(t) >= FUZZY_FROM), tuple(PRIOR))

    def measure(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(model)
            for batch in batches:
                found = [matcher.hits(x.as_py()) for x in batch.column(0)]
                near = [sorted({t for t, d, _ in hits if d}) for hits in found]
                yield pa.record_batch([pa.array([features(h) for h in found], pa.list_(pa.float64())), pa.array(near, pa.list_(pa.string())), batch.column(1)], ["x", "near", "y"])

        return rows.select("text", "y").mapInArrow(run, "x array<double>, near array<string>, y int").collect()

    wrong, right = Counter(), Counter()
    for r in measure(draft):
        (right if r.y else wrong).update(r.near)
    fuzzy = frozenset(t for t in draft.fuzzy if wrong[t] == 0 or right[t] * scale >= PRECISION * (right[t] * scale + wrong[t]))
    last = measure(Model(terms, fuzzy, tuple(PRIOR)))
    drop_stored(rows)
    weights = logistic.fit(np.array([r.x for r in last], dtype=float).reshape(-1, len(PRIOR)), np.array([r.y for r in last], dtype=float), PRIOR, precision=0.5)
    return Model(terms, fuzzy, tuple(map(float, weights)))


def score(model: Model):
    """A pandas UDF text -> score in 0..1, over whole texts; null counts as empty."""
    weights = np.array(model.weights)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model)
        for texts in batches:
            x = np.array([features(matcher.hits(t)) for t in texts], dtype=float).reshape(-1, len(weights))
            yield pd.Series(logistic.sigmoid(x @ weights))

    return run


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold; columns as they are.

    Every row is judged by its own text: repeated rows stay repeated, ids may be null, and a null or empty text is kept.
    """
    return docs.where(score(train(docs, labels))(F.col("text").cast("string")) < THRESHOLD)


def op3_toxicity(spark, sf_dir):
    """Query: toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, score(train(docs, labels))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
