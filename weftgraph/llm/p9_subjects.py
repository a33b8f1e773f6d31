"""Problem 9: the subjects of each document.

Method: class-association rules. The sentences of a bounded sample of labelled documents are transactions of stemmed word n-grams and of the labels
of their document. Parallel frequent-pattern growth mines the patterns of all n-grams that speak for a subject at all, alone or with others; rules
from terms to a subject are made of the patterns with a label, whatever their length, and a rule is redundant if a more general one is as sure. The
surety of the surest rule that a sentence matches is its evidence for a subject; labelled documents that no rule was mined from show how often such
evidence is right, which calibrates it. A sentence deals with the subjects that its calibrated evidence makes likely, and a document with those of at
least a quarter of its sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import kept

#: Labelled documents that rules are mined from and calibrated on; of more, those with the least hash of their id are taken. One in so many calibrates.
SAMPLE, HELD_OUT = 20_000, 5
#: Sentences that must hold a pattern, the surety of a rule, and how many pseudo-sentences pull it to the subject's overall share.
LEAST_SUPPORT, LEAST_SURE, PRIOR = 3, 0.5, 1.0
#: Of more sentences a pattern must be in this share of them, one in so many; and by how much a special rule must be surer than a general one.
ONE_IN, MARGIN = 5_000, 0.05
#: A term may stand in a rule with others if a subject goes with it so many times as often as overall, and with a chi-square that one in a thousand terms
#: reaches by chance.
LEAST_LIFT, LEAST_CHI = 2.0, 10.83
#: How likely the calibrated evidence must make a subject; steps of evidence, and pseudo-sentences that pull each step to its own value.
LEAST_LIKELY, STEPS, PSEUDO = 0.5, 20, 10
#: A document's share of sentences, as a fraction.
SHARE_NUM, SHARE_DEN = 1, 4
#: Words of the longest n-gram, and of the shortest sentence.
LONGEST, LEAST_WORDS = 3, 3

_CUT = re.compile(r"(?<=[.!?。])[\"'”»)*_`]*\s+|[\r\n\v\f\x85  ]+|(?<=。)")
_END = re.compile(r"[.!?。][\"'”»)*_`\s]*$")
_CODE = re.compile(r"[{}=]|->|\( ?[&\w]+ ?[,)]|\w\(")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text: what ends with a full stop, a question or an exclamation mark; lines of code, headings and lone words don't count."""
    return [s for s in _CUT.split(text) if s and _END.search(s) and not _CODE.search(s)]


def stem(word: str) -> str:
    """A word in lower case without the ending of an English plural."""
    w = word.lower()
    if len(w) > 3 and w.endswith("es"):
        w = w[:-2]
    elif len(w) > 2 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w.endswith("e") else w


class _Stems(dict):
    """The stems of runs of letters and digits, remembered: joined words have several, numbers none."""

    def __missing__(self, run: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        self[run] = out = tuple(stem(w) for w in _HUMP.sub(" ", run).split(" ") if w and not w.isdigit())
        return out


_STEMS = _Stems()


def stems(sentence: str) -> list[str]:
    """The stemmed words of a sentence in order; joined and hyphenated words count as several, numbers not at all."""
    known = _STEMS
    return [s for run in _WORD.findall(sentence) for s in known[run]]


def grams(words: list[str], known: frozenset[str] | set[str]) -> set[str]:
    """The n-grams all of whose words are known."""
    out, run = set(), []
    if known.isdisjoint(words):
        return out
    for w in words:
        if w not in known:
            run.clear()
            continue
        run.append(w)
        gram = w
        out.add(gram)
        for n in range(2, min(LONGEST, len(run)) + 1):
            gram = f"{run[-n]} {gram}"
            out.add(gram)
    return out


def parts(gram: str) -> list[str]:
    """The shorter n-grams inside an n-gram."""
    w = gram.split(" ")
    return [" ".join(w[i : i + n]) for n in range(1, len(w)) for i in range(len(w) - n + 1)]


@dataclass(frozen=True)
class Rules:
    """For each rule its terms, its subject and how sure it is; ``by_term`` finds rules by their first term in order. ``words`` are those of all terms;
    ``likely`` says for each step of evidence how often it is right."""

    by_term: dict[str, list[tuple[frozenset, str, float]]]
    words: frozenset[str] = frozenset()
    likely: tuple[float, ...] = tuple((i + 0.5) / STEPS for i in range(STEPS))

    def evidence(self, words: list[str]) -> dict[str, float]:
        """The surety of each subject: that of the surest rule that a sentence matches."""
        out: dict[str, float] = {}
        found = grams(words, self.words)
        for term in found:
            for terms, subject, sure in self.by_term.get(term, ()):
                if sure > out.get(subject, 0) and terms <= found:
                    out[subject] = sure
        return out

    def subjects(self, words: list[str]) -> list[str]:
        """The subjects that a sentence is likely to deal with."""
        return [x for x, sure in self.evidence(words).items() if self.likely[_step(sure)] >= LEAST_LIKELY]


def _step(sure: float) -> int:
    return min(STEPS - 1, int(sure * STEPS))


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, found = [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            for s in sentences(text or ""):
                row.append(i)
                found.append(stems(s))
        row = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), pa.array(found, pa.list_(pa.string()))], ["doc_id", "subjects", "words"])


def _gram_counts(known):
    """``(term, subject, n, sentences)`` of the sentences of each batch; an empty subject counts all sentences with the term, and has their hashes combined,
    so that terms of the same sentences are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[tuple[str, str]] = Counter()
            held: dict[str, int] = {}
            for subjects, words, h in zip(*(c.to_pylist() for c in b.columns)):
                found = grams(words, known.value)
                for s in ("", *subjects):
                    count.update((t, s) for t in found)
                for t in found:
                    held[t] = held.get(t, 0) ^ h
            keys = list(count)
            cols = [pa.array([t for t, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([0 if s else held[t] for t, s in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["term", "subject", "n", "sentences"])

    return run


def _baskets(items, labels, known):
    """Sentences as lists of numbers: those of their terms, and those of their labels below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for subjects, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [items.value[t] for t in grams(words, known.value) if t in items.value]
                if found:
                    out.append(found + [labels[s] for s in subjects])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["items"])

    return run


def _items(counts: dict[str, dict[str, int]], prior: dict[str, int], total: int, sentences_of: dict[str, int]) -> dict[str, float]:
    """The terms that speak for a subject, surely or at least more than by chance, and how surely; without those inside which a shorter one is as sure, and
    of terms that stand in the same sentences one alone."""
    sure: dict[str, float] = {}
    for t, k in counts.items():
        n = k[""]
        best = max(((v / n, s) for s, v in k.items() if s), default=(0.0, ""))[0]
        chi = max((total * (total * v - n * prior[s]) ** 2 / (n * prior[s] * (total - n) * (total - prior[s]) or 1) for s, v in k.items() if s and total * v >= LEAST_LIFT * n * prior[s]), default=0.0)
        if best >= LEAST_SURE or chi >= LEAST_CHI:
            sure[t] = best
    kept_: dict[tuple[int, int], str] = {}
    for t, c in sorted(sure.items(), key=lambda x: (len(x[0]), x[0])):
        if not any(p in sure and sure[p] + MARGIN >= c for p in parts(t)):
            kept_.setdefault((counts[t][""], sentences_of[t]), t)
    return {t: sure[t] for t in sorted(kept_.values())}


def _rules(share: dict[tuple[frozenset[str], str], float], words: frozenset[str]) -> Rules:
    """The rules that are sure enough, more general ones first, without redundant ones: those that hold a rule already made which is about as sure."""
    by_term: dict[str, list[tuple[frozenset, str, float]]] = {}
    for (body, subject), sure in sorted(share.items(), key=lambda x: (len(x[0][0]), sorted(x[0][0]), x[0][1])):
        if sure >= LEAST_SURE and not any(s == subject and c + MARGIN >= sure and b <= body for t in body for b, s, c in by_term.get(t, ())):
            by_term.setdefault(min(body), []).append((body, subject, sure))
    return Rules(by_term, words)


def _hits(rules):
    """``(step, n, hits)``: how often evidence of each step is right, in the sentences of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hits = Counter(), Counter()
            for subjects, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for subject, sure in rules.value.evidence(words).items():
                    n[_step(sure)] += 1
                    hits[_step(sure)] += subject in subjects
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([hits[k] for k in n], pa.int64())], ["step", "n", "hits"])

    return run


def calibrated(found: dict[int, tuple[int, int]]) -> tuple[float, ...]:
    """How often each step of evidence is right, from ``(n, hits)`` of some steps: never less for more evidence (pooled where it would be)."""
    pools: list[list[float]] = []  # right, all, steps
    for i in range(STEPS):
        n, hits = found.get(i, (0, 0))
        pools.append([hits + PSEUDO * (i + 0.5) / STEPS, n + PSEUDO, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return tuple(right / all_ for right, all_, steps in pools for _ in range(int(steps)))


def mine(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Rules:
    """The rules that the labelled documents support, calibrated on those held out.

    Labels that are no subject, and labels of absent documents, don't count. All counts are over the sample, whose size is bounded, and so is what
    reaches the driver.
    """
    sc = documents.sparkSession.sparkContext
    known = labels.join(subjects.select("subject"), "subject", "left_semi").select("doc_id", "subject").distinct()
    sample = known.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    docs = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = kept(docs.select("doc_id", "text", "subjects").mapInArrow(_sentence_rows, "doc_id long, subjects array<string>, words array<string>"))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)) == 0
    mined, apart = rows.where(~held).select("subjects", "words", F.xxhash64("doc_id", "words").alias("h")), rows.where(held).select("subjects", "words")
    prior = {r["subject"]: r["n"] for r in mined.select(F.explode(F.array_union("subjects", F.array(F.lit("")))).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = prior.pop("", 0)
    if not total:
        rows.unpersist()
        return Rules({})
    least = max(LEAST_SUPPORT, total // ONE_IN)
    often = mined.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    words = sc.broadcast(frozenset(often.select("w").toArrow().column(0).to_pylist()))
    found = mined.mapInArrow(_gram_counts(words), "term string, subject string, n long, sentences long")
    found = found.groupBy("term", "subject").agg(F.sum("n").alias("n"), F.bit_xor("sentences").alias("sentences"))
    found = found.groupBy("term").agg(F.collect_list(F.struct("subject", "n")).alias("c"), F.bit_xor("sentences").alias("sentences"), F.max("n").alias("most")).where(F.col("most") >= least)
    counts, sentences_of = {}, {}
    for t, cells, h in zip(*(c.to_pylist() for c in found.select("term", "c", "sentences").toArrow().columns)):
        counts[t], sentences_of[t] = {x["subject"]: x["n"] for x in cells}, h
    items, names = _items(counts, prior, total, sentences_of), sorted(prior)
    smoothed = lambda n, k, s: (k + PRIOR * prior[s] / total) / (n + PRIOR)
    share = {(frozenset([t]), s): smoothed(counts[t][""], k, s) for t in items for s, k in counts[t].items() if s}
    # A term that is sure of its subject to within the margin makes any longer rule redundant; the others are mined for rules of several.
    open_ = [t for t, c in items.items() if c + MARGIN < 1]
    used = frozenset(w for t in items for w in t.split(" "))
    numbers = sc.broadcast({t: i for i, t in enumerate(open_)})
    baskets = kept(mined.mapInArrow(_baskets(numbers, {s: -i - 1 for i, s in enumerate(names)}, sc.broadcast(used)), "items array<int>"))
    n_baskets = baskets.count()
    if n_baskets:
        patterns = FPGrowth(itemsCol="items", minSupport=least / n_baskets).fit(baskets).freqItemsets
        body, label = F.sort_array(F.filter("items", lambda x: x >= 0)), F.filter("items", lambda x: x < 0)
        patterns = patterns.select(body.alias("body"), label.alias("label"), "freq").where(F.size("label") <= 1)
        whole = patterns.where((F.size("label") == 0) & (F.size("body") > 1)).select("body", F.col("freq").alias("n"))
        ruled = patterns.where((F.size("label") == 1) & (F.size("body") > 1)).join(whole, "body").where(F.col("freq") >= F.col("n") * (LEAST_SURE - MARGIN))
        for own, (x,), k, n in zip(*(c.to_pylist() for c in ruled.select("body", "label", "freq", "n").toArrow().columns)):
            share[frozenset(open_[i] for i in own), names[-x - 1]] = smoothed(n, k, names[-x - 1])
    rules = _rules(share, used)
    steps = apart.mapInArrow(_hits(sc.broadcast(rules)), "step int, n long, hits long").groupBy("step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    rules = replace(rules, likely=calibrated({r["step"]: (r["n"], r["hits"]) for r in steps.collect()}))
    rows.unpersist()
    baskets.unpersist()
    return rules


def _score(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules.value
        for b in batches:
            ids, names, hits, sizes = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                all_ = sentences(text or "")
                count = Counter(subject for s in all_ for subject in known.subjects(stems(s)))
                for subject, n in sorted(count.items()):
                    ids.append(i), names.append(subject), hits.append(n), sizes.append(len(all_))
            cols = [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(hits, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "subject", "n_hits", "n_sentences"])

    return run


def scored(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(doc_id, subject, n_hits, n_sentences)``: how many of a document's sentences deal with a subject, for each with any."""
    rules = documents.sparkSession.sparkContext.broadcast(mine(documents, labels, subjects))
    return documents.select("doc_id", "text").mapInArrow(_score(rules), "doc_id long, subject string, n_hits int, n_sentences int")


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(doc_id, subject)``: the subjects that at least a quarter of the document's sentences deal with.

    Null, empty and blank texts, texts without sentences and texts that no rule matches have none; without labels there are no rows. Labels are
    used to mine rules alone: a labelled document is scored like any other. Repeated rows of a document count once.
    """
    found = scored(documents, labels, subjects).where(F.col("n_hits") * SHARE_DEN >= F.col("n_sentences") * SHARE_NUM)
    return found.where(F.col("n_sentences") > 0).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(subject, n_documents)``: how many documents deal with each subject, 0 among them."""
    found = subjects_of(documents, labels, subjects).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return subjects.select("subject").join(found, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("n_documents"))
