"""Subject areas of documents by one-versus-rest linear classifiers on hashed n-grams (problem 9).

The unit that is classified is the sentence, since a document deals with a subject if a quarter of its
sentences do. No sentence is labelled, so weak labels are made first: hand labels say which subjects a
document has, and an expectation-maximisation over the sample's sentences, each of one subject or of none,
finds which of them carry these. Where addresses, document names and sections foretell the hand labels of
documents that they weren't learned from, they also give the other documents' likely subjects; where they
don't, all are taken for equally likely. The classifiers are then trained on the weak labels, and each
subject's threshold is set where its documents agree best with the hand labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagweave.llm import characters as C
from tagweave.llm import sentences as S
from tagweave.llm.characters import Characters, spread, units

#: Hashed features; labelled and other documents of each language in the training sample. With more languages than
#: LANGUAGES each has its even share of as many documents, so the sample is bounded and no language is left out.
WIDTH, LABELLED, OTHERS, LANGUAGES = 1 << 18, 350, 250, 20
#: Columns that hold addresses and section metadata, and the gain (in nats a held-out document) from which they are used.
METADATA, LEAST_GAIN = ("source", "doc_name", "category"), 0.05
#: Share of a document's sentences, headings aside, from which it deals with a subject.
SHARE = 0.25
#: Words of a line without end mark, before a blank line, up to which it is a heading.
HEADING_WORDS = 6
EM_ROUNDS, ROUNDS = 14, 40
#: Pseudo-count of an n-gram's shares; the share from which a subject's n-gram is telling, and how many times that of
#: the next subject it must be; the weight of no subject.
SMOOTH, TELLING, AHEAD, NONE = 2.0, 0.4, 1.8, -1.0
#: Share of a language's texts that a subject's n-gram occurs in at most, times the number of subjects.
MOST_TEXTS = 1.5
# Small words of English, German, Spanish and French.
SMALL_WORDS = ("the of and is by are must to", "die der das und ist wer nach bei im an", "el los las y del con para tras en una", "le les et du est au qui avec pour des")
#: Weight of a labelled text beside one without hand labels.
HAND_WEIGHT = 4.0
#: Documents in the sample that an n-gram must occur in.
LEAST = 3
#: N-grams and sentences that are gone through at a time, and texts of the sample whose characters are held at a time.
SLICE, SENTENCES, BLOCK = 1 << 16, 400, 250
_NO_END = S._classes(C.LOWER, C.UPPER, C.DIGIT, C.LETTER)


class Sentences:
    """Sentences of a batch of texts, headings aside, with their hashed n-grams."""

    def __init__(self, texts: list[str], model: S.Model):
        chars = Characters([unicodedata.normalize("NFC", t) for t in texts])
        text, start, end = S.cut(model, chars)
        start, end = start + chars.starts[text], end + chars.starts[text]
        u = units(chars, (C.CJK, C.THAI))
        first, after = np.searchsorted(u.start, start), np.searchsorted(u.start, end)
        follows = S._forward(chars.kinds, end, S._SPACES)
        newline_at = np.flatnonzero(chars.kinds == C.NEWLINE)
        blank_line = (np.searchsorted(newline_at, follows) - np.searchsorted(newline_at, end) >= 2) | (chars.kinds[follows] == C.EDGE)
        heading = blank_line & _NO_END[chars.kinds[end - 1]] & (after - first <= HEADING_WORDS)
        keep = ~heading & (after > first)
        self.text, first, after = text[keep], first[keep], after[keep]
        n = len(self.text)
        of = np.full(len(u.start), -1, np.int64)
        sizes = after - first
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
        of[inside] = np.repeat(np.arange(n), sizes)
        h, grams, owner = u.hash, [], []
        joined = h
        for size in (1, 2, 3, 4):
            if size > 1:
                joined = spread(joined[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[size - 1 :])
            at = np.arange(len(joined))
            same = (of[at] >= 0) & (of[at] == of[at + size - 1])
            fits = same & (u.single[at] & u.single[at + size - 1] if size > 2 else (~u.single[at] if size == 1 else True))
            at = at[fits]
            grams.append(((joined[at] >> np.uint64(40)).astype(np.int64) % WIDTH).astype(np.int32))
            owner.append(of[at].astype(np.int32))
        owner, grams = np.concatenate(owner), np.concatenate(grams)
        order = np.argsort(owner, kind="stable")
        code = chars.codes[u.start[np.minimum(first + (after - first) // 2, max(0, len(u.start) - 1))]].astype(np.int64) if n else np.zeros(0, np.int64)
        kana = np.zeros(n, bool)
        kana[of[inside[(chars.codes[u.start[inside]] >= 0x3040) & (chars.codes[u.start[inside]] < 0x3100)]]] = True
        self.script = np.where(kana, 1, np.where(code >= 0x2E80, 2, (code >> 7) + 3))  # kana, ideographs, else the block of 128
        self.owner, self.grams, self.n_texts = owner[order], grams[order], len(texts)
        self.used, self.width = slice(None), WIDTH  # the hashes that ``grams`` are numbers of

    def slices(self) -> Iterator[slice]:
        """Places of n-grams, some whole texts at a time, as what is made of all at once takes much memory."""
        first = np.searchsorted(self.owner, np.searchsorted(self.text, np.arange(self.n_texts + 1)).astype(self.owner.dtype))
        at = 0
        while at < self.n_texts:
            after = max(at + 1, int(np.searchsorted(first, first[at] + SLICE, side="right")) - 1)
            yield slice(first[at], first[after])
            at = after

    def sizes(self) -> np.ndarray:
        """Each sentence's number of n-grams, at least 1."""
        return np.maximum(1, np.bincount(self.owner, minlength=len(self.text)))

    def only_frequent(self, least: int) -> None:
        """Drops n-grams in fewer than ``least`` texts, and numbers the others, so that tables by n-gram hold no more than these."""
        texts = np.zeros(WIDTH, np.int64)
        for own in self.slices():
            pairs = np.unique(self.grams[own].astype(np.int64) * self.n_texts + self.text[self.owner[own]])
            np.add.at(texts, pairs // self.n_texts, 1)
        self.used = np.flatnonzero(texts >= least)
        self.width, number = len(self.used), np.full(WIDTH, -1, np.int32)
        number[self.used] = np.arange(self.width)
        grams = number[self.grams]
        keep = grams >= 0
        self.owner, self.grams = self.owner[keep], grams[keep]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each sentence, the sum of its n-grams' rows of ``weights``."""
        out = np.zeros((len(self.text), weights.shape[1]))
        starts = np.flatnonzero(np.r_[True, np.diff(self.owner) != 0]) if len(self.owner) else np.zeros(0, np.int64)
        bounds = np.r_[starts[::SENTENCES], len(self.owner)]
        held = np.empty((np.diff(bounds).max(initial=0), weights.shape[1]), weights.dtype)
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            own = starts[SENTENCES * i : SENTENCES * (i + 1)]
            rows = weights.take(self.grams[a:b], axis=0, out=held[: b - a], mode="clip")
            out[self.owner[own]] = np.add.reduceat(rows, own - a, axis=0)
        return out

    def counts(self, values: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """For each n-gram, the sum of its sentences' rows of ``values``, each ``times`` the n-gram's own."""
        columns, out, slices = np.ascontiguousarray(values.T), np.zeros((values.shape[1], self.width)), list(self.slices())
        for column, total in zip(columns, out):
            for own in slices:
                x = column.take(self.owner[own].astype(np.intp))
                np.add.at(total, self.grams[own].astype(np.intp), x if times is None else x * times[own])
        return np.ascontiguousarray(out.T)


def sentences_of(texts: list[str], model: S.Model, block: int = BLOCK) -> Sentences:
    """The sentences of many texts, made block by block, as their characters take far more memory than their n-grams."""
    parts = [Sentences(texts[i : i + block], model) for i in range(0, len(texts), block)] or [Sentences([], model)]
    out, before = parts[0], np.cumsum([0, *(len(p.text) for p in parts)])
    out.text = np.concatenate([p.text + i * block for i, p in enumerate(parts)])
    out.owner = np.concatenate([p.owner + np.int32(n) for p, n in zip(parts, before)])
    out.grams, out.script = (np.concatenate([getattr(p, c) for p in parts]) for c in ("grams", "script"))
    out.n_texts = len(texts)
    return out


def _languages(s: Sentences) -> np.ndarray:
    """A number for each sentence's language, by small words or by script: near enough to count a language's texts."""
    votes = np.zeros((WIDTH, len(SMALL_WORDS)))
    for k, line in enumerate(SMALL_WORDS):
        u = units(Characters([line]))
        votes[(u.hash >> np.uint64(40)).astype(np.int64) % WIDTH, k] = 1
    count = s.sums(votes[s.used])
    return np.where(count.any(1), count.argmax(1), len(SMALL_WORDS) + s.script)


def _widespread(s: Sentences, n_subjects: int) -> np.ndarray:
    """N-grams in so many of their language's texts that they belong to its sentence patterns, not to a subject."""
    _, language = np.unique(_languages(s), return_inverse=True)
    n = int(language.max(initial=0)) + 1
    texts = np.bincount(np.unique(language * s.n_texts + s.text) // s.n_texts, minlength=n)
    count = np.zeros(s.width * n, np.int64)
    for own in s.slices():
        owner = s.owner[own]
        np.add.at(count, np.unique((s.grams[own].astype(np.int64) * n + language[owner]) * s.n_texts + s.text[owner]) // s.n_texts, 1)
    count = count.reshape(s.width, n)
    return (count > np.maximum(MOST_TEXTS / n_subjects * texts, 4)).any(1)


def metadata_parts(values: Sequence[str | None]) -> set[str]:
    """What metadata hold: each value, and the parts of its path or name, with the number of its column."""
    out = set()
    for k, v in enumerate(values):
        plain = (v or "").strip().lower()
        out |= {f"{k}:{x}" for x in [plain, *re.split(r"[\W\d_]+", plain)] if x}
    return out


def metadata_prior(parts: list[set[str]], given: np.ndarray) -> tuple[np.ndarray | None, float]:
    """How likely each subject is for each text by its metadata alone, and how much better than the subjects' shares it
    foretells the hand labels of texts that weren't learned from, in nats a text; None if that is less than LEAST_GAIN.

    Naive Bayes over the parts of the metadata, in two folds.
    """
    known = np.flatnonzero(given.any(1))
    k = given.shape[1]
    if len(known) < 20 or k < 2:
        return None, 0.0
    target = given / np.maximum(1, given.sum(1, keepdims=True))
    number = {x: i for i, x in enumerate(sorted(set().union(*(parts[i] for i in known))))}
    rows = [[number[x] for x in p if x in number] for p in parts]

    def learned(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = (target[own].sum(0) + 0.5) / (target[own].sum() + 0.5 * k)
        counts = np.zeros((len(number), k))
        for i in own.tolist():
            counts[rows[i]] += target[i]
        return np.log(base), np.log((counts + 5 * base) / (counts.sum(1, keepdims=True) + 5)) - np.log(base)  # towards the shares where little is known

    def told(own: np.ndarray, base: np.ndarray, weights: np.ndarray) -> np.ndarray:
        logits = np.stack([base + weights[rows[i]].sum(0) for i in own.tolist()])
        return logits - np.logaddexp.reduce(logits, 1, keepdims=True)

    gain = 0.0
    for fold in (0, 1):
        held, own = known[fold::2], known[1 - fold :: 2]
        base, weights = learned(own)
        gain += float((target[held] * (told(held, base, weights) - base)).sum())
    gain /= len(known)
    if gain < LEAST_GAIN:
        return None, gain
    return np.exp(told(np.arange(len(parts)), *learned(known))), gain


def weak_labels(s: Sentences, given: np.ndarray, n_subjects: int, likely: np.ndarray | None = None) -> np.ndarray:
    """Share of each sentence in each subject (the last column: none). ``given[text, subject]``: hand labels;
    ``likely[text, subject]``: what is likely of the others, if anything is.

    An n-gram counts once a text, for the subjects of the sentence it stands in; it is telling if one subject
    has most of it. Sentences are of the subjects of their telling n-grams, texts of those of their sentences,
    which makes more n-grams telling, in languages with few hand labels too. Sentences without any are of
    none, and count for their text's subjects when n-grams are counted: so the words of sentence patterns,
    which go with all subjects, never become telling.
    """
    n, k = len(s.text), n_subjects
    labelled = given.any(1)
    prior = np.full((s.n_texts, k), 1 / k) if likely is None else likely.copy()
    prior[labelled] = 0.01
    prior[given] = 1.0
    prior /= prior.sum(1, keepdims=True)
    strength = np.where(labelled, 3.0, 0.3)[:, None]
    once = np.empty(len(s.grams))
    for own in s.slices():
        _, of, times = np.unique(s.grams[own].astype(np.int64) * s.n_texts + s.text[s.owner[own]], return_inverse=True, return_counts=True)
        once[own] = 1.0 / times[of]
    may = ~_widespread(s, k)[:, None]
    q = prior[s.text] * labelled[s.text][:, None]
    r = np.zeros((n, k + 1))
    for _ in range(EM_ROUNDS):
        counts = s.counts(q, once)
        base = q.sum(0) / max(1e-9, q.sum())
        share = (counts + SMOOTH * base) / (counts.sum(1, keepdims=True) + SMOOTH)
        second = np.partition(share, -2, axis=1)[:, -2:-1]
        telling = may & (share >= TELLING) & (share >= AHEAD * second) & (counts > 1.5)
        weights = np.where(telling, np.log(np.maximum(share, 1e-12) / np.maximum(base, 1e-9)), 0.0)
        evidence = np.minimum(s.sums(weights), 12.0)
        found = evidence.max(1) > 0
        theta = prior
        for _ in range(2):
            logits = np.concatenate([evidence + np.log(theta)[s.text], np.full((n, 1), NONE)], 1)
            r = np.exp(logits - logits.max(1, keepdims=True))
            r[~found] = 0
            r[~found, -1] = 1
            r /= r.sum(1, keepdims=True)
            theta = np.stack([np.bincount(s.text, r[:, z], s.n_texts) for z in range(k)], 1) + strength * prior
            theta /= theta.sum(1, keepdims=True)
        sure = labelled | (np.bincount(s.text, found, s.n_texts) > 0)
        # a labelled text stays with its hand labels unless much speaks against them, and counts more
        own = labelled[s.text][:, None]
        q = np.where(own, np.exp(0.3 * evidence) * (0.5 * theta + prior)[s.text], np.exp(evidence) * theta[s.text])
        q = q / q.sum(1, keepdims=True) * sure[s.text][:, None] * np.where(own, HAND_WEIGHT, 1.0)
    return r


def train(s: Sentences, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one logistic classifier per subject, on soft labels."""
    k = target.shape[1]
    if not len(s.text):
        return np.zeros((WIDTH, k), np.float32), np.full(k, -10.0)
    w, b = np.zeros((s.width, k)), np.log((target.mean(0) + 1e-3) / (1 - target.mean(0) + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    scale = 1 / np.sqrt(s.sizes())[:, None]
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(s.sums(w) * scale + b, -30, 30)))
        off = (p - target) / len(s.text)
        g = s.counts(off * scale) + 1e-7 * w
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-9) * (v > 0)
        b -= 0.5 * off.sum(0)
    weights = np.zeros((WIDTH, k), np.float32)
    weights[s.used] = w
    return weights, b


def probabilities(s: Sentences, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s.sums(w[s.used]) / np.sqrt(s.sizes())[:, None] + b, -30, 30)))


def shares(s: Sentences, p: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """For each text and subject, the share of its sentences that deal with it."""
    hit = p >= thresholds
    total = np.maximum(1, np.bincount(s.text, minlength=s.n_texts))
    return np.stack([np.bincount(s.text, hit[:, z], s.n_texts) for z in range(p.shape[1])], 1) / total[:, None]


def calibrate(s: Sentences, p: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Each subject's threshold: where the labelled documents agree best with their hand labels, nearest a half."""
    known = given.any(1)
    best, score = np.full(p.shape[1], 0.5), np.full(p.shape[1], -1.0)
    for t in sorted(np.arange(0.3, 0.71, 0.05), key=lambda x: abs(x - 0.5)):
        found = shares(s, p, np.full(p.shape[1], t)) >= SHARE
        both = (found & given)[known].sum(0)
        f1 = 2 * both / np.maximum(1, found[known].sum(0) + given[known].sum(0))
        better = f1 > score + 0.01
        best[better], score[better] = t, f1[better]
    return best


class Classifier:
    def __init__(self, names: list[str], boundaries: S.Model, weights: np.ndarray, intercepts: np.ndarray, thresholds: np.ndarray):
        self.names, self.boundaries, self.weights, self.intercepts, self.thresholds = names, boundaries, weights, intercepts, thresholds

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        s = Sentences(texts, self.boundaries)
        return shares(s, probabilities(s, self.weights, self.intercepts), self.thresholds), np.bincount(s.text, minlength=len(texts))


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each language, chosen by the hash of ``doc_id``, so that rare languages are learned too.

    Languages are the first two letters of ``lang``; missing ones count as one. ``ids(doc_id, lang, subjects)``
    hold no text, so that nothing large is joined or sorted to find the sample.
    """
    coded = ids.withColumn("_code", F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("?")))
    counts = coded.groupBy("_code").agg(F.count("*").alias("_n"))
    n_codes = counts.count()
    share = most * LANGUAGES // max(LANGUAGES, n_codes)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("_n")
    return coded.join(counts, "_code").where(place < F.lit(share * (1 << 20))).drop("_code", "_n").limit(most * (LANGUAGES + 1))


def sample(documents: DataFrame, labels: DataFrame) -> list:
    """Rows ``doc_id, subjects, text`` and metadata of the training sample: ids are chosen first, then their texts read."""
    hand = labels.where("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject")).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    ids = documents.where("text is not null and doc_id is not null").select("doc_id", lang.alias("lang")).join(hand, "doc_id", "left")
    known = _sampled(ids.where("subjects is not null"), LABELLED)
    rest = _sampled(ids.where("subjects is null"), OTHERS).withColumn("subjects", F.array().cast("array<string>"))
    chosen = known.unionByName(rest).select("doc_id", "subjects").toArrow()  # at most (LANGUAGES + 1) * (LABELLED + OTHERS) ids
    few = F.broadcast(documents.sparkSession.createDataFrame(chosen))
    about = [F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in METADATA]
    return documents.where("text is not null").select("doc_id", "text", *about).join(few, "doc_id").limit(2 * max(1, chosen.num_rows)).collect()


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, boundaries: S.Model) -> Classifier:
    """Trains on about LABELLED labelled and OTHERS other documents of each language."""
    areas = areas.where("subject is not null").select("subject", "description").distinct().orderBy("subject").collect()
    areas = list({a.subject: a for a in areas}.values())
    names = [a.subject for a in areas]
    number = {a.lower().strip(): i for i, a in enumerate(names)}
    rows = sorted(sample(documents, labels), key=lambda r: (r.doc_id, r.text))
    words = [r.text for r in rows] + [a.description or "" for a in areas]
    given = np.zeros((len(words), len(names)), bool)
    for i, r in enumerate(rows):
        given[i, [number[x] for x in r.subjects if x in number]] = True
    given[np.arange(len(rows), len(words)), np.arange(len(names))] = True
    likely, _ = metadata_prior([metadata_parts([r[c] for c in METADATA]) for r in rows], given[: len(rows)])
    if likely is not None:
        likely = np.concatenate([likely, np.full((len(areas), len(names)), 1 / max(1, len(names)))])
    s = sentences_of(words, boundaries)
    s.only_frequent(LEAST)
    target = weak_labels(s, given, len(names), likely)[:, :-1]
    weights, intercepts = train(s, target)
    return Classifier(names, boundaries, weights, intercepts, calibrate(s, probabilities(s, weights, intercepts), given))


def _classify(classifier: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(classifier.names)
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                part, count = classifier.of(batch.column(1).to_pylist())
                doc, subject = np.nonzero(part >= SHARE)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), names.take(pa.array(subject)), pa.array(part[doc, subject]), pa.array(count[doc].astype(np.int32))], ["doc_id", "subject", "share", "n_sentences"])

    return run


def document_subjects(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, subject, share, n_sentences`` of every subject that a document deals with.

    Whole texts are cut into sentences and classified where they lie, without a shuffle. Documents of no
    subject, and null or blank texts, give no row.
    """
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_classify(classifier), "doc_id long, subject string, share double, n_sentences int")
