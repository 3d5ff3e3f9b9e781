"""Subject areas of documents by class-association rules.

Sentences of labelled documents are transactions of words. Parallel frequent-pattern growth mines word sets with
their class counts: every task grows the patterns that end in its own items, from the conditional prefixes sent
to it, all patterns of a length at once. Rules that say no more than a rule on fewer words are pruned. A sentence
takes the class with most evidence, the log odds of all matching rules added up; a document's share of a subject
is the part of its words in sentences of that class. What share makes a subject is calibrated by isotonic
regression on labelled documents that the rules have not seen.

Mining runs twice. The first pass spreads a document's labels over its sentences. Its rules then say which
sentence belongs to which label, and which speak of something else in passing; the second pass learns that,
with "in passing" as one more class.

The fit uses at most ``MAX_DOCS`` labelled documents, chosen by a hash of doc_id; every document is scored.
Texts that are null, empty or without known words get no subject; texts of any length are scored whole, in any
script. Without usable labels there are no rules and no subjects.
"""

from __future__ import annotations

import html
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.runtime import Scratch, parallelism

MAX_DOCS = 20_000
HELD_OUT = 5  # one labelled document in so many calibrates and is not mined
MIN_COUNT = 5.0  # sentences that a word, and a set of words, must be in
MIN_LIFT = 1.5  # of a word, and of a rule, in its class; words that favour no class are not items
MIN_CONF = 0.5
GAIN = 0.02  # by so much a longer rule must be surer than each shorter one
SURE = 1.0 - GAIN  # no rule can be surer than this by GAIN, so growth ends there and loses nothing
COVER = 0.5  # a text has content in at least this part of its words
SPLIT = 1 << 21  # occurrences grown at once
SLICE = 1 << 22
DENSE = 1 << 24  # places of a rule table that is looked up by place, not by search

_ODD = re.compile(r"[ÂÃâ][\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}")
_TAG = r"<[^<>]{1,200}>"
_END = r"[.!?;&|\n\r]+(?:\s|$)|[\n\r&;]|\s-\s|\[\d+\]|\*\*\*|[。！？｡।؟]+"
_GAP = r"[^\p{L}\p{M}]+"
_SIGN = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}])"  # scripts without gaps: each sign is a word
#: Letters written as two.
_PAIRS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "œ": "oe", "æ": "ae"}


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def _on(texts: pa.Array, mask: pa.Array, change) -> pa.Array:
    """``change`` of the rows under the mask, the others as they are."""
    if not pc.any(mask, min_count=0).as_py():
        return texts
    return pc.replace_with_mask(texts, mask, change(texts.filter(mask)))


def _plain(texts: pa.Array) -> pa.Array:
    for a, b in _PAIRS.items():
        texts = pc.replace_substring(texts, a, b)
    return pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKD"), r"\p{Mn}+", "")


@dataclass
class Sentences:
    """Sentences of a batch of texts. Equal ones are stored once: ``words`` with the number of the sentence they are in, and
    its ``length`` in words. ``text`` and ``which`` are the texts and sentence numbers of all that occur."""

    words: pa.Array
    sentence: np.ndarray
    length: np.ndarray
    text: np.ndarray
    which: np.ndarray


def sentences(texts: pa.Array) -> Sentences:
    """Sentences of texts in lower case, without accents, markup and encoding faults; those without words are left out."""
    t = pc.fill_null(texts.cast(pa.string()), "")
    t = _on(t, pc.match_substring(t, "&"), lambda a: pa.array([html.unescape(x) for x in a.to_pylist()], pa.string()))
    t = _on(t, pc.match_substring(t, "<"), lambda a: pc.replace_substring_regex(a, _TAG, "\n"))
    ascii_ = pc.string_is_ascii(t)
    t = _on(t, pc.and_(pc.invert(ascii_), pc.match_substring_regex(t, "[ÂÃâ]")), lambda a: pa.array([_ODD.sub(_repair, x) for x in a.to_pylist()], pa.string()))
    t = pc.utf8_lower(t)
    t = _on(t, pc.invert(ascii_), _plain)
    t = _on(t, pc.and_(pc.invert(ascii_), pc.match_substring_regex(t, _SIGN)), lambda a: pc.replace_substring_regex(a, _SIGN, r" \1 "))
    parts = pc.split_pattern_regex(t, _END)
    each, text = parts.flatten().dictionary_encode(), pc.list_parent_indices(parts).to_numpy()
    split = pc.split_pattern_regex(each.dictionary, _GAP)
    words, sentence = split.flatten(), pc.list_parent_indices(split).to_numpy()
    size = pc.utf8_length(words)
    good = pc.greater(size, 1)
    lone = pc.equal(size, 1)
    good = pc.or_(good, pc.and_(lone, pc.match_substring_regex(words, "^" + _SIGN))) if pc.any(lone, min_count=0).as_py() else good
    keep = good.to_numpy(zero_copy_only=False)
    words, sentence = words.filter(good), sentence[keep]
    length = np.bincount(sentence, minlength=len(each.dictionary))
    which = each.indices.to_numpy().astype(np.int64)
    full = length[which] > 0
    return Sentences(words, sentence, length, text[full], which[full])


@dataclass
class Bags:
    """Sets of item numbers, ascending, one set after the other."""

    start: np.ndarray
    items: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.start))


def bags(sentence: np.ndarray, items: np.ndarray, n: int) -> Bags:
    """The distinct items of each of n sentences; negative items are none."""
    known = items >= 0
    wide = int(items.max(initial=0)) + 1
    key = np.unique(sentence[known].astype(np.int64) * wide + items[known])
    return Bags(np.searchsorted(key // wide, np.arange(n + 1)), key % wide)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] of them, and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


# ---- mining


def confidence(v: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The foremost class of rows of class counts, and its share, drawn towards the prior by one count."""
    k = v.argmax(1)
    return k, (v[np.arange(len(v)), k] + prior[k]) / (v.sum(1) + 1.0)


def grow(base: Bags, weight: np.ndarray, own: np.ndarray, single: np.ndarray, single_n: np.ndarray, prior: np.ndarray, least: float) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Frequent itemsets whose last item is in ``own`` and that may make a rule, with their class counts.

    ``base`` are conditional prefixes with class ``weight`` rows; ``single`` and ``single_n`` have the confidence and
    count of each item. Patterns grow from their last item towards the first, each by all items before its
    first one, so no pattern is met twice. A pattern in as many sentences as one of its parts says nothing that
    the part doesn't, nor does any longer one: neither is grown. Growth has no other bound on length.
    """
    found: list[tuple[tuple[int, ...], np.ndarray]] = []
    at = np.flatnonzero(np.isin(base.items, own))
    order = np.argsort(base.items[at], kind="stable")
    at = at[order]
    owner, wide = base.owner, len(single)
    steps = np.cumsum(at - base.start[owner[at]])
    cuts = np.searchsorted(steps, np.arange(SPLIT, steps[-1] if len(steps) else 0, SPLIT))
    edges = [0, *[int(np.searchsorted(base.items[at], base.items[at[c]])) for c in cuts], len(at)]
    for lo, hi in itertools.pairwise(sorted(set(edges))):  # whole last items at a time
        here = at[lo:hi]
        ids, pattern = np.unique(base.items[here], return_inverse=True)
        sets = [(int(i),) for i in ids]
        beat, count = single[ids], single_n[ids]
        v = np.stack([np.bincount(pattern, weight[owner[here], c], len(ids)) for c in range(weight.shape[1])], 1)
        good = v.sum(1) >= least
        k, conf = confidence(v, prior)
        found += [(sets[i], v[i]) for i in np.flatnonzero(good & (conf >= np.maximum(MIN_CONF, MIN_LIFT * prior[k])))]
        open_ = good & (v.max(1) < SURE * v.sum(1))
        while open_.any():
            keep = open_[pattern]
            here, pattern = here[keep], pattern[keep]
            n = here - base.start[owner[here]]
            nxt = _ranges(base.start[owner[here]], n)
            key = np.repeat(pattern.astype(np.int64), n) * wide + base.items[nxt]
            ids, new = np.unique(key, return_inverse=True)
            if not len(ids):
                break
            w = weight[np.repeat(owner[here], n)]
            v = np.stack([np.bincount(new, w[:, c], len(ids)) for c in range(w.shape[1])], 1)
            from_, item = ids // wide, ids % wide
            total = v.sum(1)
            k, conf = confidence(v, prior)
            bar = np.maximum(beat[from_], single[item]) + GAIN
            rule = (total >= least) & (conf >= np.maximum(bar, np.maximum(MIN_CONF, MIN_LIFT * prior[k])))
            open_ = (total >= least) & (total < 0.999 * count[from_]) & (total < 0.999 * single_n[item]) & (v.max(1) < SURE * total)
            used = np.flatnonzero(rule | open_)
            sets = {int(i): (int(item[i]), *sets[from_[i]]) for i in used}
            found += [(sets[i], v[i]) for i in np.flatnonzero(rule)]
            beat = np.maximum(bar - GAIN, np.where(conf >= MIN_CONF, conf, 0.0))
            count, here, pattern = total, nxt, new
    return found


def prune(found: dict[tuple[int, ...], np.ndarray], prior: np.ndarray) -> dict[tuple[int, ...], tuple[int, float]]:
    """Rules itemset -> (class, confidence), without those no surer than a rule on a subset."""
    rules: dict[tuple[int, ...], tuple[int, float]] = {}
    for items in sorted(found, key=len):
        k, conf = (x[0] for x in confidence(found[items][None, :], prior))
        below = [rules.get(c) for n in range(1, len(items)) for c in itertools.combinations(items, n)]
        if all(r is None or conf >= r[1] + GAIN for r in below):
            rules[items] = (int(k), float(conf))
    return rules


@dataclass
class Model:
    """Rules over words; ``classes`` are the subjects, and index len(classes) stands for "in passing"."""

    classes: list[str]
    words: list[str]
    rules: dict[tuple[int, ...], tuple[int, float]]
    share: float = 0.18
    _levels: list = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        self._words = pa.array(self.words, pa.string())
        wide = max(1, len(self.words))
        nodes: dict[tuple[int, ...], int] = {(): 0}
        depth = max(map(len, self.rules), default=0)
        self._levels = []
        for d in range(1, depth + 1):  # a trie: of each level the keys (node above, item), the nodes' rules, and whether it goes on
            heads = sorted({r[:d] for r in self.rules if len(r) >= d}, key=lambda h: (nodes[h[:-1]], h[-1]))
            key = np.array([nodes[h[:-1]] * wide + h[-1] for h in heads], np.int64)
            cls = np.array([self.rules[h][0] if h in self.rules else -1 for h in heads])
            p = np.array([self.rules[h][1] if h in self.rules else 0.5 for h in heads])
            longer = {r[:d] for r in self.rules if len(r) > d}
            table = None
            if len(nodes) * wide <= DENSE:  # the same lookup by place
                table = np.full(len(nodes) * wide, -1, np.int32)
                table[key] = np.arange(len(key))
            self._levels.append((key, table, cls, np.log(p / (1 - np.minimum(p, 0.999))), np.array([h in longer for h in heads])))
            nodes = {h: i for i, h in enumerate(heads)}

    def __getstate__(self) -> tuple:
        return self.classes, self.words, self.rules, self.share  # tables are made again where they are used

    def __setstate__(self, state: tuple) -> None:
        self.classes, self.words, self.rules, self.share = state
        self.__post_init__()

    def items(self, s: Sentences) -> Bags:
        at = pc.fill_null(pc.index_in(s.words, self._words), -1).to_numpy()
        return bags(s.sentence, at.astype(np.int64), len(s.length))

    def classify(self, sets: Bags) -> np.ndarray:
        """Class of each set by the evidence of all matching rules; -1 without a match, the lower class of equals."""
        n, wide, k = sets.n, max(1, len(self.words)), len(self.classes) + 1
        score = np.zeros(n * k)
        owner, end = sets.owner, sets.start[1:]
        pos, node = np.arange(len(sets.items)), np.zeros(len(sets.items), np.int64)
        for key, table, cls, odds, longer in self._levels:
            want = node * wide + sets.items[pos]
            if table is None:
                i = np.searchsorted(key, want)
                hit = (i < len(key)) & (key[np.minimum(i, len(key) - 1)] == want)
            else:
                i = table[want]
                hit = i >= 0
            pos, i = pos[hit], i[hit]
            rule = cls[i] >= 0
            score += np.bincount(owner[pos[rule]] * k + cls[i[rule]], odds[i[rule]], len(score))
            go = longer[i]
            pos, i = pos[go], i[go]
            more = end[owner[pos]] - pos - 1
            pos, node = _ranges(pos + 1, more), np.repeat(i, more)
        score = score.reshape(n, k)
        return np.where(score.max(1, initial=0) > 0, score.argmax(1) if n else 0, -1)

    def shares(self, s: Sentences, cls: np.ndarray, n: int) -> np.ndarray:
        """(n, classes): part of each text with a subject, at least COVER of the text, that each subject holds."""
        k, text, length, cls = len(self.classes), s.text, s.length[s.which], cls[s.which]
        on = (cls >= 0) & (cls < k)
        held = np.bincount(text[on] * k + cls[on], length[on], n * k).reshape(n, k)
        return held / np.maximum(np.maximum(held.sum(1), np.bincount(text, length, n) * COVER), 1e-9)[:, None]

    def read(self, texts: pa.Array) -> np.ndarray:
        s = sentences(texts)
        return self.shares(s, self.classify(self.items(s)), len(texts))


# ---- on Spark


def clean_labels(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, labels) with the distinct valid subjects of each document; at most MAX_DOCS documents."""
    name = F.lower(F.trim("subject"))
    known = labels.select("doc_id", name.alias("subject")).where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    per = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels"))
    return per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS)


def _clean(df: DataFrame, *cols: str) -> DataFrame:
    return df.where("doc_id is not null").select("doc_id", *cols, F.make_valid_utf8("text").alias("text"))


def _targets(hits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A document's labels spread evenly over each of its sentences."""
    return (hits / np.maximum(hits.sum(1, keepdims=True), 1))[text]


def _slices(batches):
    """The same rows in batches of about SLICE bytes of text, so memory follows neither row counts nor lengths."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy())
        cuts = np.flatnonzero(np.diff(size // SLICE, prepend=0))
        for lo, hi in itertools.pairwise([0, *cuts[cuts > 0].tolist(), b.num_rows]):
            yield b.slice(lo, hi - lo)


def _labelled(batch: pa.RecordBatch, subjects: list[str]) -> np.ndarray:
    return np.array([[s in ls for s in subjects] for ls in batch.column("labels").to_pylist()], float).reshape(batch.num_rows, len(subjects))


def _passes(batch: pa.RecordBatch, subjects: list[str], first: Model | None, passing: float = 0.15) -> tuple[Sentences, np.ndarray]:
    """Sentences of a batch and their class targets, of equal ones the sum: labels spread evenly, or by the first pass's rules."""
    s, hits = sentences(batch.column("text")), _labelled(batch, subjects)
    target = _targets(hits, s.text)
    if first is not None:
        k = len(subjects)
        cls = first.classify(first.items(s))
        share = first.shares(s, cls, batch.num_rows)
        cls = cls[s.which]
        safe = np.clip(cls, 0, k - 1)
        meant = (cls < k) & ((hits[s.text, safe] > 0) | (share[s.text, safe] >= passing))
        to = np.where(meant, safe, k)
        target = np.hstack([target, np.zeros((len(target), 1))])
        target[cls >= 0] = np.eye(k + 1)[to[cls >= 0]]
    return s, np.stack([np.bincount(s.which, target[:, i], len(s.length)) for i in range(target.shape[1])], 1)


def mine(docs: DataFrame, subjects: list[str], first: Model | None, scratch: Scratch, least: float = MIN_COUNT) -> tuple[list[str], dict[tuple[int, ...], tuple[int, float]]]:
    """Words and rules from labelled documents (labels, text)."""
    spark = docs.sparkSession
    c = len(subjects) + (first is not None)
    cs = [f"c{i}" for i in range(c)]
    typed = ", ".join(f"{x} double" for x in cs)
    model = spark.sparkContext.broadcast(first)

    def count(batches):
        for b in _slices(batches):
            s, target = _passes(b, subjects, model.value)
            code = s.words.dictionary_encode()
            sets = bags(s.sentence, code.indices.to_numpy().astype(np.int64), len(s.length))
            v = [np.bincount(sets.items, target[sets.owner, i], len(code.dictionary)) for i in range(c)]
            whole = pa.RecordBatch.from_arrays([code.dictionary, *map(pa.array, v)], ["word", *cs])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *[pa.array([float(x)]) for x in target.sum(0)]], ["word", *cs])
            yield whole

    total = sum((F.col(x) for x in cs), F.lit(0.0))
    words = docs.mapInArrow(count, f"word string, {typed}").groupBy("word").agg(*[F.sum(x).alias(x) for x in cs])
    words = words.where(F.col("word").isNull() | (total >= least)).toPandas()
    prior = words[words["word"].isna()][cs].to_numpy(float).sum(0)
    prior = prior / max(prior.sum(), 1e-9)
    words = words[words["word"].notna()]
    v = words[cs].to_numpy(float)
    lift = (v / np.maximum(v.sum(1, keepdims=True), 1e-9) / np.maximum(prior, 1e-6)).max(1, initial=0)
    words = words[lift >= MIN_LIFT].assign(n=v.sum(1)[lift >= MIN_LIFT]).sort_values(["n", "word"], ascending=[False, True])
    names, v = words["word"].to_list(), words[cs].to_numpy(float)
    single, single_n = confidence(v, prior)[1] if len(v) else np.zeros(0), v.sum(1)
    groups = 2 * parallelism(spark)
    shared = spark.sparkContext.broadcast((names, single, single_n, prior))

    def project(batches):
        vocabulary = pa.array(shared.value[0], pa.string())
        for b in _slices(batches):
            s, target = _passes(b, subjects, model.value)
            at = pc.fill_null(pc.index_in(s.words, vocabulary), -1).to_numpy().astype(np.int64)
            sets = bags(s.sentence, at, len(s.length))
            owner, g = sets.owner, sets.items % groups
            last = np.zeros(len(g), bool)  # the longest prefix each group needs of a sentence
            last[len(g) - 1 - np.unique((owner * groups + g)[::-1], return_index=True)[1]] = True
            end = np.flatnonzero(last)
            n = end - sets.start[owner[end]] + 1
            prefix = sets.items[_ranges(sets.start[owner[end]], n)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(prefix))
            yield pa.RecordBatch.from_arrays([pa.array(g[end].astype(np.int32)), lists, *[pa.array(target[owner[end], i]) for i in range(c)]], ["g", "prefix", *cs])

    sent = docs.mapInArrow(project, f"g int, prefix array<int>, {typed}").groupBy("g", "prefix").agg(*[F.sum(x).alias(x) for x in cs])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, conf, n, p = shared.value
        lists = t.column("prefix").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        base = Bags(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64), lists.flatten().to_numpy().astype(np.int64))
        w = np.stack([t.column(x).to_numpy() for x in cs], 1)
        got = grow(base, w, np.arange(key[0].as_py(), len(conf), groups), conf, n, p, least)
        return pa.table([pa.array([list(i) for i, _ in got], pa.list_(pa.int32())), *[pa.array([float(v[i]) for _, v in got]) for i in range(c)]], ["items", *cs])

    found = sent.groupBy("g").applyInArrow(run, f"items array<int>, {typed}").toPandas()
    sets = {tuple(int(x) for x in i): v for i, v in zip(found["items"], found[cs].to_numpy(float))}
    shared.unpersist()
    model.unpersist()
    return names, prune(sets, prior)


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> Model:
    """The model of ``subjects`` from documents (doc_id, text) and labels (doc_id, subject)."""
    spark, subjects = docs.sparkSession, sorted(subjects)
    scratch = Scratch(spark, "rules")
    known = F.broadcast(clean_labels(labels, subjects))  # at most MAX_DOCS short rows
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD_OUT)) == 0
    rows = scratch.keep(_clean(docs.join(known, "doc_id"), "labels").withColumn("held", held))
    seen = rows.where("not held").select("labels", "text")
    first = Model(subjects, *mine(seen, subjects, None, scratch))
    second = Model(subjects, *mine(seen, subjects, first, scratch))
    shared = spark.sparkContext.broadcast(second)

    def measure(batches):
        for b in _slices(batches):
            share, hits = shared.value.read(b.column("text")), _labelled(b, subjects)
            pc_ = np.minimum(np.floor(share * 100), 99).astype(np.int32).ravel()
            n, hit = np.bincount(pc_, minlength=100), np.bincount(pc_, hits.ravel(), 100)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(100, dtype=np.int32)), pa.array(hit), pa.array(n.astype(float))], ["pc", "hit", "n"])

    bands = rows.where("held").select("labels", "text").mapInArrow(measure, "pc int, hit double, n double")
    second.share = calibrate(bands.groupBy("pc").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).toPandas())
    shared.unpersist()
    scratch.drop_all()
    return second


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rising values nearest to y under weights w, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for a, b in zip(y, w):
        pools.append([a * b, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, t, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + t, pools[-1][2] + n]
    return np.concatenate([np.full(n, s / t) for s, t, n in pools]) if pools else np.zeros(0)


def calibrate(bands: pd.DataFrame, about: int = 18) -> float:
    """The share from which a reader more likely than not gives the label, by isotonic regression over percents of
    text. Without any documents it is ``about``, just below the fifth asked for: each percent starts with one
    document that says so. Between two percents without documents of their own the middle is taken."""
    hit, n = np.zeros(100), np.zeros(100)
    hit[bands["pc"].to_numpy(int)], n[bands["pc"].to_numpy(int)] = bands["hit"], bands["n"]
    likely = isotonic((hit + (np.arange(100) >= about)) / (n + 1), n + 1) >= 0.5
    return float(max(1, np.argmax(likely))) / 100


def subjects_of(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, share) of every document, one row for each subject it is about; of rows with the same
    doc_id the greater share. Rows without doc_id are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = pa.array(m.classes, pa.string())
        for b in _slices(batches):
            share = m.read(b.column("text"))
            i, k = np.nonzero(share >= m.share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i)), names.take(pa.array(k)), pa.array(share[i, k])], ["doc_id", "subject", "share"])

    kind = dict(docs.dtypes)["doc_id"]
    found = _clean(docs).mapInArrow(run, f"doc_id {kind}, subject string, share double")
    return found.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
