"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by templates.

A paragraph is what stands between blank lines. Every paragraph is classified
whole: by itself if it is short, else in windows of 64 and of 16 words that
overlap by half, so that long notices are seen whole and short ones undiluted. A sparse multinomial logistic regression over the distinct
word n-grams (1 to 3) gives probabilities of the licence families, of
``unknown`` (a licence of no known family) and of ``none``. n-grams that training
did not see weigh nothing. Windows that are not ``none`` and touch are a passage.
Notices that follow one another in a passage are judged each: the shortest runs
of its lines and sentences that confirm a family are notices of their own, and
what is left between them is judged by itself.

A family is reported if its calibrated probability reaches the threshold and a
template confirms it: the share of a template's words, rare ones weighing more,
that the passage holds in the template's order is at least CONFIRM, and no other
family among the likeliest four fits its template better. What is a licence but
not a confirmed family is ``unknown``.

Training. Positives are the templates with words dropped and set into windows of
prose; ``unknown`` are notices of invented names and, for the calibration,
families left out of a second fit; ``none`` are windows of the corpus without
a word of LICENCE_WORDS, of any length, at most SAMPLE documents of least hash,
and everyday uses of such words. The temperature minimises the loss on held-out
examples; the threshold is the least one at which at most ALARM of the passages
of left-out families would be confirmed.

n-grams are looked up for a batch at a time: word numbers, their pairs and triples
as integers, running sums of the weights found, differences for the windows. These
count an n-gram as often as it stands there, so a window that they find to be no
prose is judged once more by its distinct ones.

No shuffle but the sample's: a row is judged alone, in memory bounded by its
text. Defined cases: null or empty text has no licence; a text of any length is
read whole; ties go to the family of less name; repeated rows are judged each;
extra columns are not read; an empty table trains on the templates alone and
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.sampling import least_hash
from textloom.llm.text_columns import words
from textloom.sources.tables import table

SAMPLE, WINDOWS = 1000, (64, 16)
CONFIRM, ALARM = 0.7, 0.05
#: Words of notices: sampled prose that holds one is no example of ``none``. They decide nothing else.
LICENCE_WORDS = r"licen[cs]|copyright|copyleft|\(c\)|©|warrant|permission|rights reserved|public domain|redistribut|creative commons|\bcc0\b"
_LICENCE = re.compile(LICENCE_WORDS, re.I)
#: Words that are looked up at once.
SLICE = 100_000
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*|©")
#: Where a line or a sentence ends.
_UNIT_END = re.compile(r"\n|(?<=[.;!?])[ \t]+(?=[^\Wa-z_0-9]|©|\()")
#: Lines or sentences that a notice may run over.
RUN = 6
_BLANK = re.compile(r"\n[ \t\r]*\n")
NONE, UNKNOWN = "none", "unknown"

#: Short notices of public licences, by family.
TEMPLATES = {
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache 2.0 license."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Licensed under the 3-clause BSD License.", "Use of this source code is governed by a BSD-style license."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal license"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL license."),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mpl-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "subject to the terms of the Mozilla Public License, v. 2.0"),
    "proprietary": ("All rights reserved.", "This material may not be reproduced without the written permission of the copyright holder."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Everyday sentences that hold a word of LICENCE_WORDS.
EVERYDAY = """He lost his driving license on the way home
The restaurant has a license to sell wine
She asked the teacher for permission to leave
The warranty of the car ended last year
A copyright lawyer spoke at the meeting
The court issued a warrant for the arrest
The land is in the public domain and open to walkers
They want to redistribute the money to the poor
Poetic licence allows the writer to do so
The nurse renewed her licence in the spring
With the permission of the owner they crossed the field
A fishing license costs ten dollars a year""".split("\n")
_INVENTED = ("Licensed under the {0} License, version {1}.", "Released under the {0} License.", "This work is licensed under the {0} Public License, version {1}.", "Distributed under the terms of the {0} Licence v{1}.", "Use of this software is subject to the {0} license agreement.", "You may redistribute this work under the {0} License.")


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def ngrams(ws: list[str]) -> list[str]:
    return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines, in order; together with those they are the whole text."""
    cuts = [(0, 0), *(m.span() for m in _BLANK.finditer(text)), (len(text), len(text))]
    return [(a, b) for (_, a), (b, _) in zip(cuts, cuts[1:]) if b > a]


@lru_cache(maxsize=4096)
def windows(n: int, sizes: tuple[int, ...] = WINDOWS) -> tuple[tuple[int, int], ...]:
    """Ranges of words, in order, that cover n of them for each size: all, or ``size`` at a time overlapping by half."""
    out = set()
    for size in sizes:
        out |= {(0, n)} if n <= size else {*((a, a + size) for a in range(0, n - size, size // 2)), (n - size, n)}
    return tuple(sorted(out)) if n else ()


def _weights() -> dict[str, float]:
    """Words that few templates hold weigh more, so that a template is not met by its common phrases alone."""
    held = [set(tokens(t)) for ts in TEMPLATES.values() for t in ts]
    return {w: float(np.log1p(len(held) / sum(w in h for h in held))) for h in held for w in h}


WEIGHTS = _weights()


def coverage(template: list[str], ws: list[str]) -> float:
    """Weighted share of the template's words found in ws in the template's order, within a stretch of twice its length."""
    best, first, total = 0.0, set(template[:3]), sum(WEIGHTS[t] for t in template)
    for i, w in enumerate(ws):
        if w in first:
            # heaviest common subsequence with the stretch that starts here
            part = ws[i : i + 2 * len(template)]
            row = [0.0] * (len(part) + 1)
            for t in template:
                diagonal = 0.0
                for k, x in enumerate(part, 1):
                    diagonal, row[k] = row[k], diagonal + WEIGHTS[t] if x == t else max(row[k], row[k - 1])
            best = max(best, row[-1] / total)
    return best


def fit_of(family: str, ws: list[str]) -> float:
    return max(coverage(tokens(t), ws) for t in TEMPLATES[family])


@dataclass
class Example:
    words: list[str]
    label: str


def synthetic(families: list[str], prose: list[list[str]], rng: np.random.Generator, copies: int = 30) -> list[Example]:
    """Templates, and notices of invented names, with words dropped and prose around them."""
    out = []

    def add(ws: list[str], label: str) -> None:
        ws = [w for w in ws if rng.random() > 0.06] or ws
        if prose:
            p = prose[rng.integers(len(prose))]
            k, near = int(rng.integers(0, len(p) + 1)), WINDOWS[int(rng.integers(0, len(WINDOWS)))] // 2
            ws = p[:k][-near:] + ws + p[k:][:near]
        out.append(Example(ws, label))

    for f in families:
        for t in TEMPLATES[f]:
            for _ in range(copies):
                add(tokens(t), f)
    letters = np.array(list("abdefgiklmnoprstuvz"))
    for k in range(copies * len(_INVENTED)):
        name = " ".join("".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(rng.integers(1, 3)))
        add(tokens(_INVENTED[k % len(_INVENTED)].format(name, f"{rng.integers(1, 6)}.{rng.integers(0, 4)}")), UNKNOWN)
    return out


@dataclass
class Model:
    """Weights by n-gram and class; temperature and threshold by calibration."""

    classes: list[str]
    vocab: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def __post_init__(self) -> None:
        """Tables for windows(): numbers of words, and sorted keys of word pairs and triples with their n-grams."""
        grams = [g.split(" ") for g in self.vocab]
        self.word = {w: k for k, w in enumerate(sorted({w for g in grams for w in g}))}
        self.none = self.classes.index(NONE)
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        for n in (1, 2, 3):
            found = sorted((self._key([self.word[w] for w in g]), k) for g, k in zip(grams, self.vocab.values()) if len(g) == n)
            self.keys.append((np.array([x for x, _ in found], np.int64), np.array([k for _, k in found], np.int64)))

    def _key(self, words: list) -> int:
        key = 0
        for w in words:
            key = key * (len(self.word) + 1) + w
        return key

    def window_logits(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the windows first .. last of word numbers (-1: not in the vocabulary)."""
        out = np.tile(self.bias, (len(first), 1))
        for n, (keys, rows) in enumerate(self.keys, 1):
            if len(words) < n or not len(keys):
                continue
            parts = [words[k : len(words) - n + 1 + k] for k in range(n)]
            key = self._key(parts)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == key) & np.all([p >= 0 for p in parts], 0))
            total = np.zeros((len(hit) + 1, len(self.classes)))
            np.cumsum(self.weights[rows[at[hit]]], 0, out=total[1:])
            lo, hi = np.searchsorted(hit, first), np.searchsorted(hit, np.maximum(first, last - n + 1))
            out += total[hi] - total[lo]
        return out

    def numbers(self, ws: list[str]) -> list[int]:
        return [self.word.get(w, -1) for w in ws]

    def logits(self, ws: list[str]) -> np.ndarray:
        ids = [k for g in set(ngrams(ws)) if (k := self.vocab.get(g)) is not None]
        return self.bias + self.weights[sorted(ids)].sum(0)

    def softmax(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def probabilities(self, ws: list[str]) -> np.ndarray:
        return self.softmax(self.logits(ws))

    def is_none(self, ws: list[str]) -> bool:
        return bool(self.probabilities(ws)[self.none] >= 0.5)

    def judge(self, ws: list[str]) -> tuple[str, float, float]:
        """(family, probability, template coverage); family is none, unknown or a confirmed one."""
        p = self.probabilities(ws)
        if p[self.none] >= 0.5:
            return NONE, float(p[self.none]), 0.0
        order = [k for k in np.argsort(-p, kind="stable") if self.classes[k] not in (NONE, UNKNOWN)]
        fits = {f: fit_of(f, ws) for f in (self.classes[k] for k in order[:4])}
        top = self.classes[order[0]]
        sure = p[order[0]] >= self.threshold and fits[top] >= CONFIRM and fits[top] >= max(fits.values())
        return (top, float(p[order[0]]), fits[top]) if sure else (UNKNOWN, float(1 - p[self.none]), fits[top])


def fit(examples: list[Example], classes: list[str], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Multinomial logistic regression on sparse rows, by AdaGrad over full batches; n-grams of four examples or more."""
    seen: dict[str, int] = {}
    rows = [set(ngrams(e.words)) for e in examples]
    for r in rows:
        for g in r:
            seen[g] = seen.get(g, 0) + 1
    vocab = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n > 3))}
    ids = [np.array(sorted(vocab[g] for g in r if g in vocab), np.int64) for r in rows]
    size = np.array([len(i) for i in ids])
    flat, row = np.concatenate(ids), np.repeat(np.arange(len(ids)), size)
    y = np.zeros((len(ids), len(classes)), np.float32)
    y[np.arange(len(ids)), [classes.index(e.label) for e in examples]] = 1
    share = y.mean(0)
    part = np.where(share > 0, 1.0, 0.0)  # classes weigh alike, and ``none`` as much as all others
    part[classes.index(NONE)] *= part.sum() - 1
    weight = (y @ (part / np.maximum(share, 1e-9)) / max(1.0, part.sum()))[:, None].astype(np.float32)
    w, b = np.zeros((len(vocab), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    by_word = np.argsort(flat, kind="stable")
    words_at, docs_at = flat[by_word], row[by_word]
    starts = np.flatnonzero(np.diff(words_at, prepend=-1))
    bounds = np.cumsum(size) - size
    some = size > 0
    for _ in range(rounds):
        z = np.tile(b, (len(ids), 1))
        z[some] += np.add.reduceat(w[flat], bounds[some], axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = weight * (p - y) / len(ids)
        g = ridge * w
        g[words_at[starts]] += np.add.reduceat(d[docs_at], starts, axis=0)
        gw += g * g
        gb += d.sum(0) ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * d.sum(0) / np.sqrt(gb)
    w[np.abs(w) < 1e-3] = 0.0
    return Model(classes, vocab, w.astype(float), b.astype(float))


def _nll(model: Model, examples: list[Example], t: float) -> float:
    z = np.array([model.logits(e.words) for e in examples]) / t
    z -= z.max(1, keepdims=True)
    at = [model.classes.index(e.label) for e in examples]
    return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(at)), at]))


def train(prose: list[list[str]], seed: int = 7) -> Model:
    """The calibrated model; prose: windows of words from the corpus."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    classes = [*families, NONE, UNKNOWN]
    clean = [p for p in prose if not _LICENCE.search(" ".join(p))] or [["the", "of", "and"]]
    none = [Example(p, NONE) for p in clean] + [Example(p[: int(rng.integers(0, WINDOWS[-1] + 1))], NONE) for p in clean]
    none += [Example(tokens(s) + clean[k % len(clean)][: k % 9], NONE) for s in EVERYDAY for k in range(20)]
    data = none + synthetic(families, clean, rng)
    part = rng.random(len(data)) < 0.8
    model = fit([e for e, t in zip(data, part) if t], classes)
    held = [e for e, t in zip(data, part) if not t]
    model.temperature = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: _nll(model, held, t))
    # every third family is left out of a second fit: what it then gets is what an unknown licence would
    alien = []
    for k in range(3):
        out = families[k::3]
        rest = [c for c in classes if c not in out]
        second = fit([e for e, t in zip(data, part) if t and e.label in rest], rest, rounds=60)
        second.temperature = model.temperature
        for e in held:
            if e.label in out:
                x, top = max((x, c) for x, c in zip(second.probabilities(e.words), rest) if c not in (NONE, UNKNOWN))
                alien.append(x if fit_of(top, e.words) >= CONFIRM else 0.0)
    model.threshold = float(np.clip(np.quantile(alien, 1 - ALARM), 0.5, 0.9)) if alien else 0.5
    return model


def sample_prose(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOWS[0]) -> list[list[str]]:
    """A window of words from each of at most ``sample`` documents of least hash; the driver gets these words only."""
    w = words(F.col("text"))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size("w") - window, F.lit(1))).cast("int") + 1
    few = least_hash(docs.select("doc_id", "text"), F.xxhash64("doc_id"), sample).filter("text is not null")
    few = few.select(F.col("_h").alias("h"), "doc_id", w.alias("w")).filter(F.size("w") > 0)
    rows = few.select("h", "doc_id", F.array_join(F.slice("w", at, window), " ").alias("x")).collect()
    return [tokens(r["x"]) for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"] or 0)) if tokens(r["x"])]


SCHEMA = "doc_id long, n_passages long, family string, probability double, coverage double, span_start long, span_end long, families array<string>"


def notices(model: Model, text: str, a: int, b: int) -> list[tuple[str, float, float, int, int]]:
    """(family, probability, coverage, start, end) of each notice in the passage a .. b: the whole, unless several lines or sentences are no prose."""
    cuts = [a, *(m.end() for m in _UNIT_END.finditer(text, a, b)), b]
    units = [(x, y) for x, y in zip(cuts, cuts[1:]) if _WORD.search(text, x, y)]
    marked = [not model.is_none(tokens(text[x:y])) for x, y in units]
    if sum(marked) < 2:
        return [(*model.judge(tokens(text[a:b])), a, b)]
    judged = lambda i, j: (*model.judge(tokens(text[units[i][0] : units[j][1]])), units[i][0], units[j][1])
    held, taken = {}, [False] * len(units)  # first unit: (last unit, notice)
    for size in range(1, RUN + 1):  # the shortest first: a longer run with a notice in it is that notice
        for i in range(len(units) - size + 1):
            if any(marked[i : i + size]) and not any(taken[i : i + size]):
                found = judged(i, i + size - 1)
                if found[0] not in (NONE, UNKNOWN):
                    held[i] = (i + size - 1, found)
                    taken[i : i + size] = [True] * size
    out, i = [], 0
    while i < len(units):
        if i in held:
            last, found = held[i]
            out.append(found)
            i = last + 1
            continue
        j = next((k for k in range(i, len(units)) if taken[k]), len(units))
        if any(marked[i:j]):  # what is left: the end of the notice before it, if that gains by it, or judged by itself
            both = model.judge(tokens(text[out[-1][3] : units[j - 1][1]])) if out else (NONE, 0.0, 0.0)
            if out and both[0] == out[-1][0] and both[2] > out[-1][2]:
                out[-1] = (*both, out[-1][3], units[j - 1][1])
            else:
                out.append(judged(i, j - 1))
        i = j
    return out


def passages(model: Model, texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(text number, windows, spans of its passages in code points) of every text that has a window that is not none; whole texts, in slices of words."""
    numbers, first, last, where = [], [], [], []

    def judge() -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        p = model.softmax(model.window_logits(np.array(numbers, np.int64), np.array(first, np.int64), np.array(last, np.int64)))[:, model.none]
        for k in np.flatnonzero(p < 0.5):
            yield where[k]

    def found() -> Iterator[tuple[int, int, int, int, int]]:
        for k, text in enumerate(texts):
            for a, b in paragraphs(text or ""):
                ws = list(map(str.lower, _WORD.findall(text, a, b)))
                base = len(numbers)
                numbers.extend(model.numbers(ws))
                for x, y in windows(len(ws)):
                    first.append(base + x)
                    last.append(base + y)
                    where.append((k, a, b, x, y))
                if len(numbers) >= SLICE:
                    yield from judge()
                    for held in (numbers, first, last, where):
                        held.clear()
        if where:
            yield from judge()

    now, n, spans, words_of = None, 0, [], (None, [])
    for k, a, b, x, y in found():
        if k != now:
            if spans:
                yield now, n, spans
            now, n, spans = k, 0, []
        if words_of[0] != (k, a):
            words_of = ((k, a), [m.span() for m in _WORD.finditer(texts[k], a, b)])
        lo, hi = words_of[1][x][0], words_of[1][y - 1][1]
        if model.is_none(tokens(texts[k][lo:hi])):
            continue
        n += 1
        # the paragraph's white space and signs go with its outer words
        lo, hi = a if x == 0 else lo, b if y == len(words_of[1]) else hi
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    if spans:
        yield now, n, spans


_NOTHING = (0, NONE, None, None, None, None, [])


def scan_texts(model: Model, texts: list[str | None]) -> list[tuple]:
    """Rows of SCHEMA without doc_id: the best passage, and all families in order of name. span: code points."""
    out = [_NOTHING] * len(texts)
    for k, _, spans in passages(model, texts):
        found = []
        for a, b in spans:
            for family, p, c, x, y in notices(model, texts[k], a, b):
                if family != NONE:
                    found.append((family == UNKNOWN, -c, -p, family, x, y))
        if found:
            _, c, p, family, a, b = min(found)
            out[k] = (len(spans), family, -p, -c, a, b, sorted({f[3] for f in found}))
        else:
            out[k] = (len(spans), *_NOTHING[1:])
    return out


def scan_text(model: Model, text: str | None) -> tuple:
    return scan_texts(model, [text])[0]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to SCHEMA, a row a document."""
    storage.bounded_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # templates' n-grams and those of the bounded sample

    def run(batches):
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        for b in batches:
            cols = list(zip(*scan_texts(held.value, b.column(1).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names)

    return docs.mapInArrow(run, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(sample_prose(docs))).withColumn("families", F.array_join("families", ","))
