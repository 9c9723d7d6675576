"""Text cut off by field limits or broken transfers.

Per source, lengths follow a log-normal that is right-censored at the source's
limits; it is fitted by maximum likelihood (EM for censored observations). At
a candidate limit the fit says how many texts would end there by themselves,
and so how likely a text of that length was cut. That posterior is the prior
to which the evidence of the ending is added: no final newline, a hunk with
lines missing, and how a line of that kind usually ends in the corpus. How
much each of these weighs is learned by EM over the pooled counts, starting
from texts at limits (cut) and texts that end with a newline (whole); weak
priors stand for what a small table does not show. The rate of cuts and the
habit of ending without a newline are then learned source by source.

One Arrow pass reads the texts and sends a row of features per document and
counts of line endings per batch; everything after works on those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
RUN = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]|_")
SENTENCE = frozenset(".。!?！？")
LIST_ITEM = re.compile(r"\s*[-*#+]\s")
TRAILER = re.compile(r"[A-Z][A-Za-z-]+: ")
FIELD = re.compile(r"[\w.-]+ ?[=:] ?\S")
FACTS = "row int, doc_id long, source string, n_chars long, n_bytes long, nl boolean, hunk string, a string, b string, n long"


def kind_of(line: str, first: bool) -> str:
    """What a line outside a hunk is; endings are compared within a kind."""
    if first:
        return "first"
    if line.startswith(("diff ", "index ", "--- ", "+++ ", "@@", "Index: ", "Binary ", "From ", "commit ")):
        return line[:3]
    if LIST_ITEM.match(line):
        return "item"
    if TRAILER.match(line):
        return line[: line.index(":")]
    return "field" if FIELD.match(line) else "prose"


def opaque(word: str) -> bool:
    """Whether a word shows nothing by its end: ids, keys, addresses with digits in them."""
    return len(word) >= 12 and any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


def last_runs(line: str) -> list[str]:
    """The last two runs of letters, digits, blanks or one sign, whole; only as much of the line is read as they take."""
    size = 80
    while True:
        runs = RUN.findall(line[-size:])
        if len(runs) > 2 or size >= len(line):
            return runs[-2:]
        size *= 8


def tails(line: str, kind: str) -> tuple[str, str]:
    """The last two runs and the last run of a line, digits as 9; sentence ends and opaque words stand alone."""
    last = line[-1:]
    if last in SENTENCE or not last.isspace() and opaque(line[max(line.rfind(" "), line.rfind("\t")) + 1 :]):
        tail = f"{kind}\t{'.' if last in SENTENCE else '*'}"
        return tail, tail
    runs = ["9" if r.isdigit() else " " if r.isspace() else r for r in last_runs(line)]
    return f"{kind}\t{''.join(runs)}", f"{kind}\t{runs[-1] if runs else ''}"


def read_text(text: str, endings: Counter) -> tuple[bool, str, str, str]:
    """(final newline, state of the last hunk, two-run tail, one-run tail); terminated lines are added to ``endings``.

    The hunk state is ``none``, ``closed``, or ``open`` when the text ends with
    lines of a hunk still to come.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    nl = lines[-1] == ""
    if nl:
        lines.pop()
    old = new = 0
    state, end = "none", len(lines) - 1
    tail = ("", "")
    for i, line in enumerate(lines):
        if old > 0 or new > 0:
            c = line[:1]
            if c == "-":
                old -= 1
            elif c == "+":
                new -= 1
            elif c != "\\":
                old, new = old - 1, new - 1
            if i == end:
                tail = (f"hunk\t{'' if nl else line[-1:]}", "hunk")
            continue
        if line.startswith("@@") and (m := HUNK.match(line)):
            old, new, state = int(m[1] or 1), int(m[2] or 1), "closed"
        if line or i == end:
            tail = tails(line, kind_of(line, i == 0))
            if i < end or nl:
                endings[tail] += 1
    return nl, "open" if old > 0 or new > 0 else state, *tail


def features(documents: DataFrame) -> DataFrame:
    """Rows of two sorts: 0 a document's features, 1 a count of line endings of a source (summed later)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            endings: dict[str, Counter] = {}
            for doc_id, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    nl, hunk, a, b = read_text(text, endings.setdefault(source, Counter()))
                    out.append((0, doc_id, source, len(text), len(text.encode("utf-8", "surrogatepass")), nl, hunk, a, b, 1))
            out += [(1, None, s, None, None, None, None, a, b, n) for s, c in endings.items() for (a, b), n in c.items()]
            types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["row", "doc_id", "source", "n_chars", "n_bytes", "nl", "hunk", "a", "b", "n"])

    return documents.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, FACTS)


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _upper(z: np.ndarray) -> np.ndarray:
    return np.maximum(np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)]), 1e-300)


def fit_censored(x: np.ndarray, n: np.ndarray, cut: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of a normal from values ``x`` with counts ``n``; where ``cut``, the value is only known to be larger."""
    mu, sd = float(np.average(x, weights=n)), 1.0
    for _ in range(rounds):
        z = (x - mu) / sd
        hazard = _phi(z) / _upper(z)
        e1 = np.where(cut, mu + sd * hazard, x)
        e2 = np.where(cut, sd * sd * (1 + z * hazard - hazard**2), 0) + (e1 - mu) ** 2
        new = float(np.average(e1, weights=n))
        sd2 = float(np.average(e2, weights=n) - (new - mu) ** 2)
        done, mu, sd = abs(new - mu) < 1e-6, new, max(math.sqrt(max(sd2, 1e-6)), 0.05)
        if done:
            break
    return mu, sd


#: Log odds, beyond the number of lengths looked at, by which a limit stands out.
STANDS_OUT = 12.0


def _surprise(seen: float, rate: float) -> float:
    """Chernoff's bound: minus the log probability that a Poisson count of ``rate`` reaches ``seen``; 0 if it is not above it."""
    return seen * math.log(seen / rate) - seen + rate if seen > rate else 0.0


def _limits(rows: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source from (unit, size, nl, n): lengths that stand out, whose texts end without newline, with the fit's posterior.

    In bytes a limit is a window of four: a cut keeps whole characters. How
    many texts stand out is tested against the Poisson rate of the lengths
    around, over all lengths of the source, not against a count.
    """
    out = []
    for unit, part in rows.groupby("unit"):
        total = part.groupby("size")["n"].sum().sort_index()
        bare = part[~part["nl"].astype(bool)].groupby("size")["n"].sum().reindex(total.index, fill_value=0)
        size, count, open_ = total.index.to_numpy(), total.to_numpy(float), bare.to_numpy(float)
        width = 4 if unit == "bytes" else 1
        cum, cumo = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(open_)])
        at = lambda c, lo, hi: c[np.searchsorted(size, hi, "right")] - c[np.searchsorted(size, lo, "left")]
        found = []
        for s, here in zip(size, count):
            mass, unended = at(cum, s - width + 1, s), at(cumo, s - width + 1, s)
            around = max(at(cum, s - 60, s - width) / (60 - width + 1), at(cum, s + 1, s + 60) / 60, 0.02)
            # A limit leaves few longer texts (an ellipsis or converted line ends may add to it).
            longer = cum[-1] - cum[np.searchsorted(size, s + 3, "right")]
            if longer <= 2 * mass and unended >= 0.9 * mass and min(_surprise(here, around), _surprise(unended, around * width)) >= STANDS_OUT + math.log(len(size)):
                found.append((s, mass))
        found = [f for f in found if not any(0 < o[0] - f[0] < width for o in found)]
        if not found:
            continue
        cut = np.zeros(len(size), bool)
        for s, _ in found:
            cut |= (size > s - width) & (size <= s)
        mu, sd = fit_censored(np.log(np.maximum(size, 1)), count, cut)
        for s, mass in found:
            z = (np.log(max(s, 1)) - mu) / sd
            own = cum[-1] * width * float(_phi(np.array(z))) / (sd * s)
            out.append((rows["source"].iloc[0], unit, int(s), width, float(mass), max(0.02, min(0.995, 1 - own / max(mass, 1))), mu, sd))
    columns = ["source", "unit", "limit_at", "width", "mass", "censored", "mu", "sd"]
    found = pd.DataFrame(out, columns=columns)
    # A unit explains a limit better if more texts sit on it: of chars and bytes within a few, keep the fuller.
    keep = [not any(abs(o.limit_at - r.limit_at) <= 4 and o.unit != r.unit and (o.mass / o.width, o.unit == "chars") > (r.mass / r.width, r.unit == "chars") for o in found.itertuples()) for r in found.itertuples()]
    return found[keep] if len(found) else found


def limits(docs: DataFrame) -> DataFrame:
    """The limits of every source; a source sends one row per distinct length, not per text."""
    sizes = docs.select("source", "nl", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("size")))).alias("x"))
    counts = sizes.groupBy("source", "nl", "x.unit", "x.size").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").applyInPandas(_limits, "source string, unit string, limit_at long, width int, mass double, censored double, mu double, sd double")


def _bucket(c: str) -> Column:
    return F.when(F.col(c) == 0, 0).when(F.col(c) <= 2, 1).when(F.col(c) <= 9, 2).otherwise(3)


HUNKS, SEEN = ("none", "closed", "open"), (0, 1, 2, 3, 9)
# What endings look like before any data: by how often the corpus ends lines so (never, once or twice, up to nine times, more; in a hunk).
CUT_TAIL = {0: 0.5, 1: 0.2, 2: 0.12, 3: 0.08, 9: 0.1}
WHOLE_TAIL = {0: 0.07, 1: 0.18, 2: 0.25, 3: 0.45, 9: 0.05}
CUT_HUNK = {"none": 0.6, "closed": 0.1, "open": 0.3}
WHOLE_HUNK = {"none": 0.7, "closed": 0.2999, "open": 0.0001}
CUT_NEWLINE = 0.01
#: Weight of these priors, in texts.
PRIOR_TEXTS = 20.0


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def ending_weights(pooled: pd.DataFrame) -> pd.DataFrame:
    """Log likelihood ratios (cut against whole) of the endings, and what they rest on: (nl, hunk, s2, s1, ratio, usual, newline).

    ``usual`` is the share of an ending among the whole texts of all sources,
    ``newline`` how often a cut text ends with a newline all the same.

    ``pooled`` counts (nl, hunk, s2, s1, censored) over all sources, at most a
    few thousand rows. EM: the cut texts are those at limits as far as the
    limit's posterior says, those that end with a newline and no open hunk
    below a limit are whole; the others take part by their posterior.
    """
    c = pooled.copy()
    n, nl, lim = c["n"].to_numpy(float), c["nl"].to_numpy(bool), c["censored"].to_numpy(float)
    opened = (c["hunk"] == "open").to_numpy()
    tail = c["s2"].to_numpy() * 10 + c["s1"].to_numpy()
    first = np.where(lim > 0, np.where(nl, 0.0, lim), np.where(opened, 0.9, np.where(nl, 0.0, 0.02)))
    settled = (lim > 0.9) & ~nl | (lim == 0) & nl & ~opened
    kinds = [a * 10 + b for a in SEEN for b in SEEN]
    prior_cut = np.array([CUT_TAIL[a] * CUT_TAIL[b] for a in SEEN for b in SEEN])
    prior_whole = np.array([WHOLE_TAIL[a] * WHOLE_TAIL[b] for a in SEEN for b in SEEN])
    prior = np.log(prior_cut / prior_whole)
    at, hunk_at = np.searchsorted(kinds, tail), c["hunk"].map({h: i for i, h in enumerate(HUNKS)}).to_numpy(int)
    p = first
    for _ in range(50):
        cut, whole = n * p, n * (1 - p)
        k = PRIOR_TEXTS
        hunk_cut = (np.bincount(hunk_at, cut, 3) + k * np.array([CUT_HUNK[h] for h in HUNKS])) / (cut.sum() + k)
        hunk_whole = (np.bincount(hunk_at, whole, 3) + k * np.array([WHOLE_HUNK[h] for h in HUNKS])) / (whole.sum() + k)
        newline = (float(cut[nl].sum()) + k * CUT_NEWLINE) / (cut.sum() + k)
        # Endings in hunks show by the hunk, the others by the line; of those seldom seen the prior says more.
        line_cut, line_whole = np.bincount(at[~opened], cut[~opened], len(kinds)), np.bincount(at[~opened], whole[~opened], len(kinds))
        own = np.log((line_cut + 0.5) / (line_cut.sum() + 0.5 * len(kinds))) - np.log((line_whole + 0.5) / (line_whole.sum() + 0.5 * len(kinds)))
        trust = (line_cut + line_whole) / (line_cut + line_whole + 3)
        lines = np.clip(own * trust + prior * (1 - trust), -7, 7)
        hunks = np.log(hunk_cut / hunk_whole)
        ratio = np.where(opened, hunks[hunk_at], lines[at])
        free = lim == 0
        rate = float((cut[free].sum() + 1) / (n[free].sum() + 100)) if free.any() else 0.01
        habit = float((whole[~nl].sum() + 0.5) / (whole.sum() + 10))
        score = np.where(free, _odds(np.full(len(n), rate)), _odds(lim)) + np.where(nl, math.log(newline / (1 - habit)), math.log((1 - newline) / habit)) + ratio
        new = np.where(settled, first, 1 / (1 + np.exp(-np.clip(score, -50, 50))))
        done, p = np.abs(new - p).max(initial=0.0) < 1e-6, new
        if done:
            break
    every = pd.MultiIndex.from_product([[False, True], HUNKS, SEEN, SEEN], names=["nl", "hunk", "s2", "s1"]).to_frame(index=False)
    every_at = np.searchsorted(kinds, every["s2"].to_numpy() * 10 + every["s1"].to_numpy())
    shown = np.where(every["hunk"] == "open", hunks[every["hunk"].map({h: i for i, h in enumerate(HUNKS)}).to_numpy(int)], lines[every_at]) if len(c) else np.zeros(len(every))
    usual = (line_whole[every_at] + 0.5) / (line_whole.sum() + 0.5 * len(kinds)) if len(c) else np.ones(len(every))
    return every.assign(ratio=shown, usual=usual, newline=newline if len(c) else CUT_NEWLINE)


def _score(rows: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    """Posterior of each feature combination of one source; EM over its cut rate and its habit of ending without a newline."""
    c = rows.merge(weights, on=["nl", "hunk", "s2", "s1"], how="left")
    n, nl, lim, ratio, usual, newline = (c[k].to_numpy(t) for k, t in (("n", float), ("nl", bool), ("censored", float), ("ratio", float), ("usual", float), ("newline", float)))
    free, opened = lim == 0, (c["hunk"] == "open").to_numpy()
    # The source's own whole endings, drawn to those of all sources where it has few.
    tail = c["s2"].to_numpy() * 10 + c["s1"].to_numpy()
    whole = np.bincount(tail, n * (free & nl & ~opened), 100)
    own = (whole[tail] + PRIOR_TEXTS * usual) / (whole.sum() + PRIOR_TEXTS)
    ratio = np.where(opened, ratio, np.clip(ratio + np.log(usual / own), -7, 7))
    # Texts count as whole until their ending speaks against it.
    rate, habit, p = 0.01, float(((n * free * ~nl).sum() + 0.5) / ((n * free).sum() + 10)), np.zeros(len(c))
    for _ in range(40):
        prior = np.where(free, _odds(np.full(len(c), rate)), _odds(lim))
        end = np.where(nl, np.log(newline / (1 - habit)), np.log((1 - newline) / habit))
        p = 1 / (1 + np.exp(-np.clip(prior + end + ratio, -50, 50)))
        w = n * free
        rate = float(((w * p).sum() + 1) / (w.sum() + 100))
        habit = float(((w * (1 - p) * ~nl).sum() + 0.5) / ((w * (1 - p)).sum() + 50))
    c["posterior"] = p
    return c[["source", "nl", "hunk", "s2", "s1", "censored", "posterior"]]


#: At most this many endings can each make up more than 1/HOT of all: the size bound of the broadcast.
HOT = 10_000


def _with_count(docs: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` with the count ``name`` of their ending ``key``; frequent endings come by broadcast, so no join key is hot."""
    total = counts.agg(F.sum(name)).first()[0] or 0
    hot = F.broadcast(counts.where(F.col(name) > total / HOT).withColumnRenamed(name, "hot"))
    marked = docs.join(hot, key, "left")
    known = marked.where("hot is not null").withColumnRenamed("hot", name)
    rest = marked.where("hot is null").drop("hot").join(counts.where(F.col(name) <= total / HOT), key, "left")
    return known.unionByName(rest)


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, n_bytes, limit_at, posterior) of every non-empty text.

    Null and empty texts are not cut and give no row. The feature combinations
    that are weighed together number at most a few hundred per source; the
    pooled ones that come to the driver, at most a few thousand.
    """
    rows = stage(features(documents))
    docs = rows.where("row = 0").drop("row", "n")
    endings = rows.where("row = 1")
    # Line endings of all sources: a source that never ends with a newline has none of its own.
    two = endings.groupBy("a").agg(F.sum("n").alias("c2"))
    one = endings.groupBy("b").agg(F.sum("n").alias("c1"))
    lim = stage(limits(docs))
    near = F.broadcast(lim) if lim.count() <= 10_000 else lim
    size = F.when(F.col("unit") == "bytes", F.col("n_bytes")).otherwise(F.col("n_chars"))
    hits = (
        docs.join(near, "source").where((size <= F.col("limit_at")) & (size > F.col("limit_at") - F.col("width")))
        .groupBy("doc_id").agg(F.max(F.struct("censored", "limit_at")).alias("hit"))
    )
    full = _with_count(_with_count(docs.join(hits, "doc_id", "left"), two, "a", "c2"), one, "b", "c1")
    # A text's own last line counts towards its ending when it is terminated.
    own = F.when(F.col("nl") & ~F.col("a").startswith("hunk"), 1).otherwise(0)
    full = full.withColumn("c2", F.coalesce("c2", F.lit(0)) - own).withColumn("c1", F.coalesce("c1", F.lit(0)) - own)
    full = stage(full.select(
        "doc_id", "source", "n_chars", "n_bytes", "nl", "hunk", F.coalesce("hit.censored", F.lit(0.0)).alias("censored"), "hit.limit_at",
        F.when(F.col("a").startswith("hunk"), 9).otherwise(_bucket("c2")).alias("s2"), F.when(F.col("a").startswith("hunk"), 9).otherwise(_bucket("c1")).alias("s1"),
    ))
    keys = ["source", "nl", "hunk", "s2", "s1", "censored"]
    combos = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spec = "source string, nl boolean, hunk string, s2 int, s1 int, censored double, posterior double"
    # Limits' posteriors count in hundredths when pooled, which bounds the rows.
    pooled = combos.groupBy("nl", "hunk", "s2", "s1", F.round("censored", 2).alias("censored")).agg(F.sum("n").alias("n")).orderBy("nl", "hunk", "s2", "s1", "censored").toPandas()
    weights = ending_weights(pooled)
    weighed = combos.groupBy("source").applyInPandas(lambda rows: _score(rows, weights), spec)
    return full.join(F.broadcast(weighed) if combos.count() <= 100_000 else weighed, keys).select("doc_id", "source", "n_chars", "n_bytes", "limit_at", "posterior")


def truncated(documents: DataFrame, at: float = 0.5) -> DataFrame:
    """(doc_id): the documents whose text lost its end."""
    return scored(documents).where(F.col("posterior") >= at).select("doc_id").distinct()


def rates(documents: DataFrame, at: float = 0.5) -> DataFrame:
    """(source, texts, cut, rate, at_limit): how often each source truncates; texts are those not empty."""
    cut = F.col("posterior") >= at
    return scored(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(cut).alias("cut"), F.round(F.avg(cut.cast("double")), 6).alias("rate"),
        F.count_if(cut & F.col("limit_at").isNotNull()).alias("at_limit"),
    )
