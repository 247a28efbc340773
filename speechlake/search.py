"""Full-text search by a positional inverted index that is a table of the store.

A posting is a row: term, transcript_id, seq, and the gaps between the term's positions in that segment. The table is
sorted by (term, transcript_id, seq), so a query opens the files whose range of terms can hold its own, a prefix* those of
one range, and a term that all segments hold is spread over files by transcript. Postings of the query's terms meet in one
exchange by segment; phrases, NEAR and the boolean operators are array expressions over the positions there.

Query syntax: words side by side or AND, OR, NOT (binary), parentheses, "phrases", a + b (one phrase), prefix*, ^first,
NEAR(a "b c" d, 5). Words side by side bind most, then NOT, AND, OR. Texts and queries are split at what is neither
letter nor digit, and compared in lower case without diacritics.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import LOOKED_UP, Log

#: A token in a text, and all that isn't one.
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"
#: Tokens of a snippet and its marks.
SHOWN, OPEN, CLOSE, MORE = 16, "<<", ">>", "..."
#: Tokens between the parts of NEAR where no number is given.
NEAR = 10


def _bases() -> tuple[str, str]:
    """Small letters with one diacritical mark, and the letters without it."""
    plain = {}
    for c in map(chr, range(0xC0, sys.maxunicode if sys.maxunicode < 0x2000 else 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and c.lower() == c and unicodedata.name(c, "").startswith("LATIN"):
            plain[c] = parts[0]
    return "".join(plain), "".join(plain.values())


_MARKED, _PLAIN = _bases()


def folded(text: Column) -> Column:
    """Lower case, without diacritical marks."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Terms of a text in order; none of a null text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    return F.transform(found, folded)


def postings(segments: DataFrame) -> DataFrame:
    """(term, transcript_id, seq, gaps): of each term of each segment (transcript_id, seq, text) its positions as differences."""
    terms = F.transform(tokens(F.col("text")), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    s = segments.select("transcript_id", "seq", F.array_sort(terms).alias("s")).where("size(s) > 0")
    # runs of one term in the sorted array: no exchange is needed to gather a segment's positions
    heads = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: ~F.get("s", i - 1)["t"].eqNullSafe(F.get("s", i)["t"]))
    s = s.withColumn("heads", heads)
    ends = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.size("s")))
    runs = F.transform(F.arrays_zip(F.col("heads").alias("a"), ends.alias("b")), lambda r: F.slice("s", r["a"] + 1, r["b"] - r["a"]))
    each = s.select("transcript_id", "seq", F.explode(runs).alias("r"))
    gaps = F.transform("r", lambda x, j: x["i"] - F.coalesce(F.get("r", j - 1)["i"], F.lit(0)))
    return each.select(F.get("r", F.lit(0))["t"].alias("term"), "transcript_id", "seq", gaps.alias("gaps"))


# --- queries


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    number: int = 0


@dataclass
class Node:
    """near (of phrases), and, or, not (of nodes)."""

    kind: str
    parts: list = field(default_factory=list)
    distance: int = NEAR


class Query:
    """A query's tree and its phrases, numbered as they come."""

    LEX = re.compile(r'"(?:[^"]|"")*"|[()+*^,]|[^\s()+*^,"]+')

    def __init__(self, text: str):
        self.phrases: list[Phrase] = []
        if re.sub(r'"(?:[^"]|"")*"', "", text).count('"'):
            raise ValueError("malformed search query: a quote is left open")
        self.left = self.LEX.findall(text)
        if not self.left:
            raise ValueError("malformed search query: it is empty")
        self.tree = self._level(["OR", "AND", "NOT"])
        if self.left:
            raise ValueError(f"malformed search query near {self.left[0]!r}")

    def _next(self) -> str | None:
        return self.left[0] if self.left else None

    def _take(self, want: str) -> None:
        if self._next() != want:
            raise ValueError(f"malformed search query: no {want!r} near {self._next()!r}")
        self.left.pop(0)

    def _level(self, operators: list[str]) -> Node:
        if not operators:
            return self._together()
        out = self._level(operators[1:])
        while self._next() == operators[0]:
            self.left.pop(0)
            out = Node(operators[0].lower(), [out, self._level(operators[1:])])
        return out

    def _together(self) -> Node:
        first, parts = self._next(), [self._one()]
        while self._next() not in (None, ")", "OR", "AND", "NOT"):
            if "(" in (first, self._next()):  # only phrases may stand side by side
                raise ValueError(f"malformed search query near {self._next()!r}")
            parts.append(self._one())
        return reduce(lambda a, b: Node("and", [a, b]), parts)

    def _one(self) -> Node:
        if self._next() == "(":
            self.left.pop(0)
            out = self._level(["OR", "AND", "NOT"])
            self._take(")")
            return out
        if self.left[:2] == ["NEAR", "("]:
            del self.left[:2]
            out = Node("near")
            while self._next() not in (")", ",", None):
                out.parts.append(self._phrase())
            if self._next() == ",":
                self.left.pop(0)
                n = self.left.pop(0) if self.left else ""
                if not n.isdigit():
                    raise ValueError(f"malformed search query: NEAR takes a number, not {n!r}")
                out.distance = int(n)
            self._take(")")
            if not out.parts:
                raise ValueError("malformed search query: NEAR of nothing")
            return out
        return Node("near", [self._phrase()])

    def _phrase(self) -> Phrase:
        out = Phrase([], number=len(self.phrases))
        if self._next() == "^":
            self.left.pop(0)
            out.first = True
        while True:
            part = self._next()
            if part is None or part in ("AND", "OR", "NOT") or not (part[0] == '"' or re.fullmatch(r"[^\x00-\x7F]|\w", part[0])):
                raise ValueError(f"malformed search query near {part!r}")
            if part[0] != '"' and not re.fullmatch(r"(?:\w|[^\x00-\x7F])+", part):
                raise ValueError(f"malformed search query near {part!r}")
            self.left.pop(0)
            out.words += [part]
            if self._next() != "+":
                break
            self.left.pop(0)
        if self._next() == "*":
            self.left.pop(0)
            out.prefix = True
        self.phrases.append(out)
        return out

    def resolve(self, spark) -> None:
        """Words of the phrases as terms, by the very expression that splits texts."""
        texts = [" ".join(w.strip('"') for w in p.words) for p in self.phrases]
        for p, t in zip(self.phrases, spark.sql("SELECT 1").select(F.array(*[tokens(F.lit(t)) for t in texts])).first()[0]):
            p.words = list(t)


def _starts(p: Phrase, slot: dict[tuple[str, bool], int]) -> Column:
    """Where a phrase begins, ascending; positions of slot i are in the array column s<i>."""
    at = [F.col(f"s{slot[w, p.prefix and k == len(p.words) - 1]}") for k, w in enumerate(p.words)]
    if not at:
        return F.array().cast("array<int>")
    out = at[0]
    for k, a in enumerate(at[1:], 1):
        out = F.array_intersect(out, F.transform(a, _minus(k)))
    out = F.array_sort(out)
    return F.filter(out, lambda x: x == 0) if p.first else out


def _minus(k: int):
    return lambda x: x - k


def _near(df: DataFrame, node: Node) -> DataFrame:
    """df with only those starts of each phrase of a NEAR that take part in a match: no phrase ends more than `distance`
    tokens before the last one begins."""
    cols, n = [f"p{p.number}" for p in node.parts], node.distance
    # a match is known by where its last phrase begins: m; every phrase must begin in [m - size - n, m]
    inside = lambda m, p: lambda x: (x <= m) & (x >= m - len(p.words) - n)
    df = df.withColumn("__m", F.array_sort(F.array_distinct(F.flatten(F.array(*cols)))))
    for c, p in zip(cols, node.parts):
        df = df.withColumn("__m", F.filter("__m", lambda m: F.exists(c, inside(m, p))))
    for c, p in zip(cols, node.parts):
        df = df.withColumn(c, F.filter(c, lambda x: F.exists("__m", lambda m: inside(m, p)(x))))
    return df.drop("__m")


def _hit(p: Phrase):
    return lambda x: F.struct(x.alias("at"), F.lit(p.number).alias("phrase"), F.lit(len(p.words)).alias("n"))


def matched(df: DataFrame, query: Query) -> DataFrame:
    """df (p<i>: where phrase i begins; others kept) of the segments that match, with hits: an array of (at, phrase, n) by place."""
    kept = [c for c in df.columns if not c.startswith("p")]
    near: list[tuple[Node, list[Node]]] = []  # with all that must hold for their hits to count

    def listed(node: Node, above: list[Node], shown: bool) -> None:
        if node.kind == "near":
            near.append((node, [*above, node] if shown else []))
        else:
            listed(node.parts[0], [*above, node], shown)
            listed(node.parts[1], [*above, node], shown and node.kind != "not")

    listed(query.tree, [], True)
    for node, _ in near:
        if len(node.parts) > 1:
            df = _near(df, node)

    def holds(node: Node) -> Column:
        if node.kind == "near":
            return reduce(lambda a, b: a & b, [F.size(f"p{p.number}") > 0 for p in node.parts])
        left, right = map(holds, node.parts)
        return {"and": left & right, "or": left | right, "not": left & ~right}[node.kind]

    none = F.array().cast("array<struct<at:int,phrase:int,n:int>>")
    hits = []
    for node, must in near:
        for p in node.parts if must else []:
            hits.append(F.when(reduce(lambda a, b: a & b, map(holds, must)), F.transform(f"p{p.number}", _hit(p))).otherwise(none))
    return df.where(holds(query.tree)).select(*kept, F.array_sort(F.flatten(F.array(*hits))).alias("hits"))


def with_snippet(df: DataFrame) -> DataFrame:
    """df (text, hits; others kept) with snippet in place of hits and text: SHOWN tokens with the hits marked.

    The window is that with most distinct phrases, then most hits, of those that begin at a hit (and are moved to hold
    what they hold in the middle) and those that begin with the sentence of a hit, which get a little more.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1))
    kept = [c for c in df.columns if c not in ("text", "hits")]
    # in steps, so that what a later step uses often is computed once; one more between than tokens
    t = df.select(*kept, "hits", pieces.alias("pieces"), F.split("text", TOKEN, -1).alias("between"))
    t = t.withColumn("n", F.size("pieces"))
    # a sentence begins with the first token and where . or : and blanks stand before a token
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | F.get("between", i).rlike(r"[.:][ \t\r\n]+$"))
    t = t.withColumn("begins", starts)

    def seen(start: Column) -> Column:
        return F.filter("hits", lambda h: (h["at"] >= start) & (h["at"] < start + SHOWN))

    def score(inside: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(inside, lambda h: h["phrase"])))
        return 1000 * distinct + F.size(inside) - distinct

    sentence = lambda h: F.element_at(F.filter("begins", lambda b: b <= h["at"]), -1)
    t = t.withColumn("w", F.transform("hits", lambda h: F.struct(h["at"].alias("at"), seen(h["at"]).alias("own"), sentence(h).alias("first"))))
    t = t.withColumn("w", F.transform("w", lambda w: F.struct(w["at"].alias("at"), w["own"].alias("own"), w["first"].alias("first"), seen(w["first"]).alias("all"))))

    def centred(w: Column) -> Column:
        last = F.element_at(w["own"], -1)
        start = w["at"] - ((SHOWN - (last["at"] + last["n"] - w["at"])) / 2).cast("int")
        return F.struct(score(w["own"]).alias("score"), F.greatest(F.least(start, F.col("n") - SHOWN), F.lit(0)).alias("start"))

    def from_sentence(w: Column) -> Column:
        good = (F.col("n") > SHOWN) & (w["first"] < w["at"])
        return F.struct(F.when(good, score(w["all"]) + F.when(w["first"] == 0, 120).otherwise(100)).otherwise(-1).alias("score"), w["first"].alias("start"))

    t = t.withColumn("w", F.flatten(F.transform("w", lambda w: F.array(centred(w), from_sentence(w)))))
    top = F.array_max(F.transform("w", lambda w: w["score"]))
    t = t.withColumn("top", top)
    t = t.withColumn("start", F.get(F.filter("w", lambda w: w["score"] == F.col("top")), F.lit(0))["start"])
    t = t.withColumn("end", F.least(F.col("start") + SHOWN, F.col("n")))

    # hits that overlap are marked as one, if they begin in the window
    def join(done: Column, h: Column) -> Column:
        last, to = F.get(done, F.size(done) - 1), h["at"] + h["n"] - 1
        longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], to).alias("b")))
        return F.when(h["at"] <= last["b"], F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(F.struct(h["at"].alias("a"), to.alias("b")))))

    marks = F.aggregate(F.filter("hits", lambda h: h["at"] < F.col("end")), F.array().cast("array<struct<a:int,b:int>>"), join)
    t = t.withColumn("marks", F.filter(marks, lambda r: r["a"] >= F.col("start")))

    def shown(i: Column) -> Column:
        before = F.when((i == F.col("start")) & (i > 0), F.lit(MORE)).otherwise(F.get("between", i))
        opens = F.exists("marks", lambda r: r["a"] == i)
        shuts = F.exists("marks", lambda r: (r["b"] == i) | ((i == F.col("end") - 1) & (r["a"] <= i) & (r["b"] > i)))
        return F.concat(before, F.when(opens, OPEN).otherwise(""), F.get("pieces", i), F.when(shuts, CLOSE).otherwise(""))

    body = F.array_join(F.transform(F.sequence(F.col("start"), F.col("end") - 1), shown), "")
    tail = F.when(F.col("end") >= F.col("n"), F.get("between", F.col("n"))).otherwise(F.lit(MORE))
    return t.select(*kept, F.concat(body, tail).alias("snippet"))


def hits_of(log: Log, query: Query, state: dict) -> DataFrame:
    """(transcript_id, seq, hits) of the segments that match; opens the files of the query's terms only."""
    slots: dict[tuple[str, bool], int] = {}
    for p in query.phrases:
        for k, w in enumerate(p.words):
            slots.setdefault((w, p.prefix and k == len(p.words) - 1), len(slots))
    exact, begun = [w for w, prefix in slots if not prefix], [w for w, prefix in slots if prefix]
    found = log.read("postings", values=exact, prefixes=begun, state=state)
    at = F.transform("gaps", lambda _, j: F.aggregate(F.slice("gaps", 1, j + 1), F.lit(0), lambda a, g: a + g))
    found = found.select("term", "transcript_id", "seq", at.alias("at"))
    mine = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(mine(*s), F.col("at")))))).alias(f"s{i}") for s, i in slots.items()]
    by = found.groupBy("transcript_id", "seq").agg(*gathered)
    by = by.select("transcript_id", "seq", *[_starts(p, slots).alias(f"p{p.number}") for p in query.phrases])
    return matched(by, query)


def search(log: Log, query: str, limit: int | None = 20) -> DataFrame:
    """transcript_id, seq, segment_id, speaker_id, snippet of the segments that match, by (transcript_id, seq); all with
    limit None. A query that can't be read raises ValueError; a phrase of no words matches nothing."""
    q = Query(query)
    q.resolve(log.spark)
    state = log.state()
    hits = hits_of(log, q, state)
    if limit is None:
        rows = log.read("segments", state=state)
    else:
        hits = hits.orderBy("transcript_id", "seq").limit(limit)
        rows = None
        if limit <= LOOKED_UP:  # few texts: only the files that can hold them are opened
            kept = hits.collect()
            hits = log.spark.createDataFrame(kept, hits.schema)
            rows = log.read("segments", values=sorted({r["transcript_id"] for r in kept}), state=state)
        rows = log.read("segments", state=state) if rows is None else rows
    cols = [c for c in ("transcript_id", "seq", "segment_id", "speaker_id") if c in rows.columns]
    out = rows.select(*cols, F.coalesce("text", F.lit("")).alias("text")).join(hits, ["transcript_id", "seq"])
    out = with_snippet(out)
    return out if limit is None else out.orderBy("transcript_id", "seq")
