"""Toxicity behind disguises: restore the text through a noisy channel, then score it.

A token that hides letters (leetspeak, symbols or marks between letters, stretched or spaced
letters) is a lattice: each character may stand for itself, for the letters it looks like, or
for nothing, and a run of one letter may stand for one or two.  Between spaced characters a word
may end, so a run of them restores to one word or to several.  A Viterbi search takes the
path with the best sum of channel costs and the log likelihood of a character trigram model,
learned from the training texts.  Every token with more than one path is searched; look-alikes
at its ends are read both as letters and as punctuation, and the reading with most evidence
counts, once.

The restored words and their beginnings are evidence if texts with them are surely (lower
confidence bound) more often toxic.  A text's evidence is the log likelihood ratio of its
counts under the rates of toxic and of other texts, which also weighs its length; a logistic
curve fitted to the training texts turns it into the score.

All labelled rows teach; their words are counted on the executors, and the logistic curve is
fitted there if the training texts are many.  Scoring covers every row and whole texts.

Defined results: null is the empty text; a text without evidence is judged by its length alone;
without labels of both classes every score is the share of toxic labels.  Null labels and labels without a document teach nothing; contradicting
labels of one id count as their maximum.  Repeated rows are scored each.  Only id and text are
read.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import release, scratch, settled

#: So many training texts' evidence is fitted on the driver; that of more is summed by Spark.
FEW = 100_000
KEPT_TOKENS = 200_000
BEGINNINGS = (5, 6, 7)
EASE = 5.0
SURE = 2.0
LEAST = 0.35
#: Letters that a character may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Channel costs in nats: a look-alike, a mark that means nothing, a look-alike that means
#: nothing, a stretched letter.
ALIKE, MARK, NOTHING, STRETCH = 1.0, 0.8, 4.0, 0.5

PLAIN_MARKS = ".,;:?\"'-_*#&%/\\^~`=<>[]{})…«»„“”‘’–—¿"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LETTER = re.compile(r"[^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_ALIKE = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "]")
#: A run of one character, also a spaced one.
_RUN = re.compile(r"(.)(?: ?\1)*", re.S)
_SINGLES = re.compile("s{2,}")


@dataclass
class Trigrams:
    """Character trigram model with add-a-tenth smoothing over ``alphabet`` letters."""
    counts: dict[str, int] = field(default_factory=dict)
    before: dict[str, int] = field(default_factory=dict)
    alphabet: int = 40
    logs: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def learn(self, word: str, times: int) -> None:
        self.logs.clear()
        w = f"^^{word}$"
        for i in range(len(w) - 2):
            self.counts[w[i:i + 3]] = self.counts.get(w[i:i + 3], 0) + times
            self.before[w[i:i + 2]] = self.before.get(w[i:i + 2], 0) + times

    def log(self, two: str, c: str) -> float:
        three = two + c
        got = self.logs.get(three)
        if got is None:
            if len(self.logs) >= KEPT_TOKENS:
                self.logs.clear()
            got = self.logs[three] = math.log((self.counts.get(three, 0) + 0.1) / (self.before.get(two, 0) + 0.1 * self.alphabet))
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character the strings it may stand for, with their costs; a space is
    an optional end of a word."""
    steps = []
    for run in _RUN.finditer(token):
        c, n = run[1], run[0].count(run[1])
        if c == " ":
            steps.append([("", 0.0), (" ", 0.0)])
            continue
        alike = LOOKS_LIKE.get(c, "")
        if c.isalpha():
            arcs = [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, STRETCH)] if n == 2 else [(c, STRETCH), (c + c, STRETCH)]
        else:
            arcs = [(x, ALIKE) for x in alike]
            arcs += [(x + x, ALIKE) for x in alike if n > 1] + [("", NOTHING if alike else MARK)]
        if " " in run[0]:
            # A word may also end within a spaced run.
            arcs += [(f"{x[0]} {x[1]}", price) for x, price in arcs if len(x) == 2] + [(" ", price) for x, price in arcs if not x]
        steps.append(arcs)
    return steps


def viterbi(token: str, model: Trigrams) -> str:
    """The word, or words with spaces between, on the lattice's best path; time and memory grow
    with the token's length alone."""
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for arcs in lattice(token):
        after: dict[str, tuple[float, tuple | None]] = {}
        for two, (score, path) in best.items():
            for letters, price in arcs:
                s, state = score - price, two
                for c in letters:
                    if c == " ":
                        s += model.log(state, "$")
                        state = "^^"
                    else:
                        s += model.log(state, c)
                        state = state[1] + c
                if state not in after or s > after[state][0]:
                    after[state] = (s, (path, letters) if letters else path)
        best = after
    path = max((s + model.log(two, "$"), two, path) for two, (s, path) in best.items())[2]
    word = []
    while path is not None:
        path, letters = path
        word.append(letters)
    return "".join(reversed(word))


def core_of(token: str) -> str:
    """A token without the marks at its ends."""
    return token if token.isalpha() else _EDGE.sub("", token)


def disguised(token: str) -> list[str] | None:
    """The readings of a token that have to be restored, or None for a plain token.

    Look-alikes at either end belong to the word in one reading and are punctuation in another."""
    if token.isalpha():
        return [token] if _DOUBLED.search(token) else None
    core = _EDGE.sub("", token)
    at = token.find(core)
    lead, tail = token[:at], token[at + len(core):]
    m = _ALIKE.search(lead)
    lead = lead[m.start():] if m else ""
    m = _ALIKE.search(tail[::-1])
    tail = tail[:len(tail) - m.start()] if m else ""
    readings = {before + core + after: None for before in (lead, "") for after in (tail, "")}
    return [r for r in readings if (_DOUBLED.search(r) if r.isalpha() else _ALIKE.search(r) or _LETTER.search(r))] or None


def single(token: str) -> str:
    """The character of a token that is one character, marks at its ends aside; else ''."""
    if len(token) == 1:
        return token
    if token.isalnum():
        return ""
    core = _EDGE.sub("", token)
    if core or len(token) != 2:
        return core if len(core) == 1 else ""
    return token[0] if token[0] in LOOKS_LIKE and token[1] != token[0] else ""


def spaced(tokens: list[str]) -> list[tuple[str, list[str]]]:
    """The runs of single characters, joined with spaces, and their tokens."""
    shape = "".join(["s" if len(t) == 1 or (not t.isalnum() and single(t)) else "w" for t in tokens])
    runs = [tokens[m.start():m.end()] for m in _SINGLES.finditer(shape)]
    return [(" ".join(map(single, run)), run) for run in runs]


def words_of(text: str) -> tuple[Counter, int]:
    """(plain words, number of tokens) of a text."""
    tokens = text.lower().split()
    plain = Counter()
    for t, n in Counter(tokens).items():
        if (core := core_of(t)).isalpha():
            plain[core] += n
    return plain, len(tokens)


def evidence_of(word: str) -> list[str]:
    """A word stands for itself and for its beginnings (inflected forms share them)."""
    return [word] + ["^" + word[:n] for n in BEGINNINGS if len(word) >= n]


@dataclass
class Model:
    """``evidence``: log ratio of a word's rate in toxic and in other texts; ``excess``: how much
    more evidence a token of a toxic text holds; ``slope`` and ``bias`` turn the sum into a chance."""
    trigrams: Trigrams
    evidence: dict[str, float]
    excess: float
    slope: float = 1.0
    bias: float = 0.0

    def weight(self, word: str) -> float:
        held = self.evidence.get
        best = held(word, 0.0)
        for n in BEGINNINGS:
            if len(word) < n:
                break
            if (got := held("^" + word[:n], 0.0)) > best:
                best = got
        return best

    def ratio(self, text: str, kept: dict[str, float]) -> float:
        """The log likelihood ratio of a text being toxic."""
        tokens = text.lower().split()
        total = -len(tokens) * self.excess
        # Marks at the ends that stand for no letter change nothing about a token's readings.
        for t, k in Counter([t.strip(PLAIN_MARKS) for t in tokens]).items():
            total += k * self._kept(t, kept, self.token)
        for run, own in spaced(tokens):
            # The characters of a run count as its words or for themselves.
            total += max(0.0, self._kept(run, kept, self.restored) - sum(self._kept(t, kept, self.token) for t in own))
        return total

    def restored(self, hidden: str) -> float:
        return sum(self.weight(w) for w in viterbi(hidden, self.trigrams).split(" "))

    def token(self, token: str) -> float:
        """The evidence of a token: of its plain word or of what it hides, whichever is more."""
        core = core_of(token)
        return max([self.weight(core) if core.isalpha() else 0.0, *map(self.restored, disguised(token) or ())])

    def score(self, text: str, kept: dict[str, float]) -> float:
        z = self.slope * eased(self.ratio(text, kept)) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def _kept(self, key: str, kept: dict[str, float], weigh: Callable[[str], float]) -> float:
        got = kept.get(key)
        if got is None:
            if len(kept) >= KEPT_TOKENS:
                kept.clear()
            got = kept[key] = weigh(key)
        return got


def eased(ratio: float) -> float:
    """Evidence as the logistic curve takes it: as it is near zero, by its logarithm far out, so a
    long text does not outweigh all others in the fit and still moves with every word."""
    return EASE * math.asinh(ratio / EASE)


def lower_bound(hits: int, n: int, z: float = SURE) -> float:
    """Wilson's lower confidence bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


_COUNTS = "word string, toxic long, other long, toxic_tokens long, other_tokens long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how many toxic and other texts hold each word, and how often; '' counts the texts."""
    for b in batches:
        words: dict[str, list[int]] = {"": [0, 0, 0, 0]}
        for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            plain, n = words_of(text or "")
            i = 0 if label else 1
            for w, k in [*plain.items(), ("", n)]:
                c = words.setdefault(w, [0, 0, 0, 0])
                c[i] += 1
                c[i + 2] += k
        rows = [(w, *c) for w, c in words.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [c.split()[0] for c in _COUNTS.split(", ")])


def _ratios(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for b in batches:
            got = [model.ratio(t or "", kept) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), b.column(2)], ["ratio", "label"])
    return run


def training_texts(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of the texts that teach, each label's copies once, for ``chosen`` (id, label).

    Which texts they are is settled on ids and hashes; the texts themselves are shuffled once."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # An id that stands in many rows teaches by one text, the one with the smallest hash.
    one = texts.select("id", "h").join(chosen, "id").groupBy("id", "label").agg(F.min("h").alias("h"))
    # Copies of a text teach as one: they would make any of its words look like evidence.
    kept = one.groupBy("h", "label").agg(F.min("id").alias("id")).select("id", F.col("h").alias("kept"))
    # Joined with all chosen ids first: what is known of them leaves out other texts before the shuffle.
    # The hashes are compared after the join: as a join key they would have the texts shuffled anew.
    return (texts.join(chosen, "id").join(kept, "id").where(F.col("h").bitwiseXOR(F.col("kept")) == 0)
            .groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label"))


def learn(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id",
          text_col: str = "text", max_train: int | None = None, seed: int = 42) -> Model:
    """Learn from all labelled rows that ``usable`` accepts, or with ``max_train`` from so many of
    them, the ones whose id hashes lowest.

    The driver gets the words that three training texts share, and a number for each training
    text up to ``FEW`` of them, for more only sums."""
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable)
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    if max_train is not None:
        chosen = chosen.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_train)
    rows = settled(training_texts(docs, chosen, id_col, text_col), "toxic-train")
    sums = [F.sum(c).alias(c) for c in ("toxic", "other", "toxic_tokens", "other_tokens")]
    got = (rows.mapInArrow(_counts, _COUNTS).groupBy("word").agg(*sums)
           .where((F.col("word") == "") | (F.col("toxic") + F.col("other") > 2)).collect())
    model = fit({r["word"]: tuple(r)[1:] for r in got})
    path = scratch(rows.sparkSession, "toxic-ratios")
    rows.mapInArrow(_ratios(model), "ratio double, label int").write.parquet(path)
    ratios = rows.sparkSession.read.schema("ratio double, label int").parquet(path)
    if ratios.count() <= FEW:
        calibrate(model, sorted((r["ratio"], 1 if r["label"] else 0) for r in ratios.collect()))
    else:
        calibrate_on(model, ratios)
    return model


def fit(words: dict[str, tuple[int, int, int, int]]) -> Model:
    words = dict(words)
    _, _, toxic_tokens, other_tokens = words.pop("", (0, 0, 0, 0))
    trigrams = Trigrams()
    tally: dict[str, list[int]] = {}
    for w in sorted(words):
        trigrams.learn(w, words[w][0] + words[w][1])
        for e in evidence_of(w):
            c = tally.setdefault(e, [0, 0, 0, 0])
            for i, k in enumerate(words[w]):
                c[i] += k
    evidence = {}
    for e, (t, o, tt, ot) in tally.items():
        if t >= 3 and lower_bound(t, t + o) >= LEAST:
            evidence[e] = math.log((tt + 0.5) / (toxic_tokens + 1)) - math.log((ot + 0.5) / (other_tokens + 1))
    found, reach = [0, 0], max(20, sum(c[0] + c[1] for c in words.values()) // 300)
    for w in sorted(words):
        if any(e in evidence for e in evidence_of(w)):
            found[0] += words[w][2]
            found[1] += words[w][3]
        if w in evidence:
            # Words that are evidence must be reachable for the search, however rare they are.
            trigrams.learn(w, reach)
    excess = max(0.0, found[0] / (toxic_tokens + 1) - found[1] / (other_tokens + 1))
    return Model(trigrams, {e: v for e, v in evidence.items() if v > 0}, excess)


def calibrate(model: Model, seen: list[tuple[float, int]], steps: int = 60) -> None:
    """Fit slope and bias of the logistic curve by Newton's method, with a weak prior."""
    ones = sum(y for _, y in seen)
    if not 0 < ones < len(seen):
        _same_for_all(model, ones, len(seen))
        return

    def sums(a: float, b: float) -> tuple[float, ...]:
        ga, gb, haa, hab, hbb = 0.1 * (a - 0.5), 0.01 * b, 0.1, 0.0, 0.01
        for x, y in seen:
            x = eased(x)
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, a * x + b))))
            ga += (p - y) * x
            gb += p - y
            v = p * (1 - p)
            haa += v * x * x
            hab += v * x
            hbb += v
        return ga, gb, haa, hab, hbb
    model.slope, model.bias = _newton(sums, steps)


def calibrate_on(model: Model, ratios: DataFrame, steps: int = 60) -> None:
    """``calibrate`` over a table (ratio, label) of any size: each step is one sum over all its rows."""
    y = F.when(F.coalesce("label", F.lit(0)) != 0, 1.0).otherwise(0.0)
    x = EASE * F.asinh(F.col("ratio") / EASE)
    rows = ratios.select(x.alias("x"), y.alias("y"))
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not 0 < (ones or 0) < n:
        _same_for_all(model, ones or 0, n)
        return

    def sums(a: float, b: float) -> tuple[float, ...]:
        z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), a * F.col("x") + b))
        p = rows.select("x", "y", (1 / (1 + F.exp(-z))).alias("p")).select("x", (F.col("p") - F.col("y")).alias("e"), (F.col("p") * (1 - F.col("p"))).alias("v"))
        e, v, x = F.col("e"), F.col("v"), F.col("x")
        got = p.agg(F.sum(e * x), F.sum(e), F.sum(v * x * x), F.sum(v * x), F.sum(v)).first()
        return tuple(g + prior for g, prior in zip(got, (0.1 * (a - 0.5), 0.01 * b, 0.1, 0.0, 0.01), strict=True))
    # Sums of floats end in digits that depend on their order: these are left out.
    model.slope, model.bias = (round(v, 9) for v in _newton(sums, steps))


def _same_for_all(model: Model, ones: float, n: int) -> None:
    share = min(0.999, max(0.001, ones / n)) if n else 0.5
    model.slope, model.bias = 0.0, math.log(share / (1 - share))


def _newton(sums: Callable[[float, float], tuple[float, ...]], steps: int) -> tuple[float, float]:
    """(slope, bias) where the gradient is zero; ``sums`` gives gradient and curvature at a point."""
    a, b = 0.5, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = sums(a, b)
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-1.0, min(1.0, da)), b - max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.score(t or "", kept) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])
        kept.clear()
        release()
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model), "id long, score double").withColumnRenamed("id", "doc_id")


def _cleaner(model: Model, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for b in batches:
            yield b.filter(pa.array([model.score(t or "", kept) < threshold for t in b.column(at).to_pylist()], pa.bool_()))
        kept.clear()
        release()
    return run


def clean(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores under ``threshold``."""
    return docs.mapInArrow(_cleaner(model, docs.columns.index(text_col), threshold), docs.schema)
