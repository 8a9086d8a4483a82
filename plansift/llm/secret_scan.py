"""Secret scans: candidates by pattern, a random forest against false positives. Built-in functions only on the data's way."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm.secret_findings import WORDS as COMMON
from plansift.llm.secret_findings import findings
from plansift.llm.spans import after, before, with_matches

#: A key's name and what assigns its value, up to an opening quote.
ASSIGNED = r"(?<=[=:>\"' \t])(?<=[=:>][ \t]{0,8}[\"']?)(?<=(?i:passw(?:or)?d|passphrase|passcode|pwd|secret|token|credential|(?:api|access|private|secret|auth)[_ -]?key)s?(?:[_-][A-Za-z0-9]{1,12})?[\"']?[ \t]{0,8}[=:]{1,2}>?[ \t]{0,8}[\"']?)"
#: Marks that are part of an unquoted value only where it goes on behind them.
_inner = r"(?:[,;&](?!\w{1,30}[ \t]{0,3}[=:])|[.)\]}>])"
#: Any value that is not blank or marks alone: up to its closing quote (200 characters, blanks too), or else up to a blank or a double quote.
VALUE = (
    r"(?:(?<=\")(?=[ \t]*[^\s\"])[^\"\n]{1,200}+(?=\")|(?<=')(?=[ \t]*[^\s'])[^'\n]{1,200}+(?=')"
    rf"|(?:{_inner}{{1,8}}+(?![\s\"']|\z))?+[^\s\"',;&.)\]}}>]++(?:(?:{_inner}|'){{1,8}}+(?![\s\"]|\z)[^\s\"',;&.)\]}}>]++){{0,200}}+=*+)"
)
PREFIXES = r"gh[pousr]_|github_pat_|sk[-_]|xox[abprs]-|glpat-|AIza"
#: The value of a key; a run that starts like a known kind of key; or a run of key characters, twelve at least, with a digit among its first 41.
CANDIDATE = rf"{ASSIGNED}{VALUE}|(?<![A-Za-z0-9+/_-])(?:A[KS]IA[A-Z2-7]{{16}}(?![A-Za-z0-9+/_-])|(?:{PREFIXES})[A-Za-z0-9+/_-]{{8,}}+={{0,2}}|(?=[A-Za-z+/_-]{{0,40}}[0-9])[A-Za-z0-9+/_-]{{12,}}+={{0,2}})"
#: A text without any of these has no candidate.
NEEDED = rf"[0-9=:]|A[KS]IA|{PREFIXES}"
#: Words that placeholders are made of, besides common ones.
DICTIONARY = "example|sample|dummy|test|your|my|key|token|secret|password|value|here|change|changeme|placeholder|insert|fake|foo|bar|xxx+|real|not|none|null|api|client|required|string|optional|undefined|unknown|true|false|deadbeef|abcdef|0123456789|1234567890|123456789|12345678|1234567|123456|" + "|".join(sorted(COMMON, key=len, reverse=True))
NEAR = 32
TREES, DEPTH, KEPT = 15, 6, 0.5

_lower = "abcdefghijklmnopqrstuvwxyz"
_kinds = (_lower + _lower.upper() + "0123456789", "a" * 26 + "A" * 26 + "0" * 10)


def _share(found: Column, pattern: str) -> Column:
    return F.lit(1.0) - F.length(F.regexp_replace(found, pattern, "")) / F.length(found)


def features(text: str, path: Column, s: Column) -> dict[str, Column]:
    """The forest's inputs for a span: length, character transitions, dictionary coverage, path, neighbouring words."""
    found, low = s["found"], F.lower(s["found"])
    kinds = F.translate(found, *_kinds)
    near, behind = F.lower(before(text, s, NEAR)), F.lower(after(text, s, NEAR))
    flag = lambda c: c.cast("double")
    return {
        "length": F.length(found).cast("double"),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.length(found),
        "case_changes": F.regexp_count(kinds, F.lit("aA|Aa")) / F.length(found),
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / F.length(found),
        "digits": _share(found, "[0-9]"),
        "upper": _share(found, "[A-Z]"),
        "marks": _share(found, "[^A-Za-z0-9]"),
        "hex": flag(found.rlike("^[0-9a-f]+$")),
        "plain_digits": flag(found.rlike("^[0-9]+$")),
        "consonants": _share(low, "[bcdfghjklmnpqrstvwxz]{3,}"),
        "dictionary": _share(low, DICTIONARY),
        "prefix": flag(found.rlike("^(?:A[KS]IA[A-Z2-7]{16}$|gh[pousr]_|sk[-_]|xox[abprs]-|glpat-|AIza)")),
        "uuid": flag(found.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-")),
        "reference": flag(found.rlike(r"^[\[<{(*%.]|^\$(?:[{(]|[A-Z_]+$)|(?i:env\b|environ)|\($|\(\)|^(.)\1*$")),
        "path_safe": flag(path.rlike(r"(?i)test|example|sample|demo|fixture|mock|lock|\.sum$")),
        "path_risky": flag(path.rlike(r"(?i)secret|prod|deploy|config|settings|\.env|credential|ops")),
        "near_key": flag(near.rlike("passw|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|credential|private[_ -]?key")),
        "near_hash": flag(near.rlike("commit|sha|checksum|md5|digest|etag|uuid|revision|hash|integrity|trace|request|order|invoice|serial|version|card|account")),
        "assigned": flag(near.rlike(r"(?:=|:)\s*[\"']?$")),
        "closed": flag(behind.rlike(r"^[\"';]")),
    }


@dataclass
class Forest:
    """trees: nested (feature, threshold, left, right), a leaf is the share of secrets; left where the feature is at most the threshold."""

    names: list[str]
    trees: list

    def score(self, row: Column) -> Column:
        """The mean of the trees' leaves for a struct of features, as one expression."""

        def of(node) -> Column:
            return F.lit(float(node)) if isinstance(node, float) else F.when(row[self.names[node[0]]] <= node[1], of(node[2])).otherwise(of(node[3]))

        return functools.reduce(lambda a, b: a + b, map(of, self.trees)) / F.lit(float(len(self.trees)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def of(node, row) -> float:
            return node if isinstance(node, float) else of(node[2] if row[node[0]] <= node[1] else node[3], row)

        return np.array([np.mean([of(t, row) for t in self.trees]) for row in x])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> Forest:
    """A random forest: each tree on a bootstrap sample, each split the best by Gini of a random third of the features."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, left: int):
        share = float(y[rows].mean())
        if left == 0 or len(rows) < 8 or share in (0.0, 1.0):
            return share
        best = None
        for f in rng.choice(x.shape[1], max(1, -(-x.shape[1] // 3)), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hits = x[order, f], np.cumsum(y[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            n = cuts + 1
            a, b = hits[cuts] / n, (hits[-1] - hits[cuts]) / (len(rows) - n)
            cost = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
            k = int(np.argmin(cost))
            if best is None or cost[k] < best[0]:
                best = cost[k], int(f), float((v[cuts[k]] + v[cuts[k] + 1]) / 2)
        if best is None:
            return share
        side = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[side], left - 1), grow(rows[~side], left - 1)

    return Forest(names, [grow(rng.integers(0, len(x), len(x)), depth) for _ in range(trees)])


def candidates(docs: DataFrame, key: str, text: str, path: str | None, *keep: str) -> DataFrame:
    """_key, _text, keep and c: array<struct<span, features>> of each row."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(path), F.lit("")).alias("_path") if path else F.lit("").alias("_path"), *keep)
    rows = with_matches(rows, "_text", {"_spans": (CANDIDATE, F.col("_text").rlike(NEEDED))})
    one = lambda s: F.struct(s.alias("span"), F.struct(*[c.alias(n) for n, c in features("_text", F.col("_path"), s).items()]).alias("features"))
    return rows.select("_key", "_text", *keep, F.transform("_spans", one).alias("c"))


_fitted: dict = {}


def learned(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None) -> Forest:
    """A forest fitted to labelled findings (text, path, 0 or 1), each text's first candidate; by default those made by rule."""
    name = "made" if rows is None else json.dumps(rows)
    if name not in _fitted:
        rows = findings() if rows is None else rows
        source = json.dumps([{"id": k, "text": t, "path": p} for k, (t, p, _) in enumerate(rows)])
        shape = "array<struct<id:int,text:string,path:string>>"
        table = spark.range(1).select(F.explode(F.from_json(F.lit(source), shape)).alias("r")).select("r.*")
        known = candidates(table, "id", "text", "path").where(F.size("c") > 0).select("_key", F.col("c")[0]["features"].alias("f")).select("_key", "f.*").collect()
        known.sort(key=lambda r: r["_key"])
        names = list(known[0].__fields__[1:])
        _fitted[name] = fit(np.array([[float(r[n]) for n in names] for r in known]), np.array([rows[r["_key"]][2] for r in known], float), names)
    return _fitted[name]


def scan(docs: DataFrame, forest: Forest | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, text and findings: array<struct<start, end, found, score>> of every candidate of the whole text.

    Places are code points, end exclusive; a candidate whose score is KEPT or more is a secret. A null text counts as empty, a null
    path as unknown; rows may repeat; other columns don't matter.
    """
    forest = forest or learned(docs.sparkSession)
    rows = candidates(docs, key, text, path, *keep)
    one = lambda c: F.struct(c["span"]["start"].alias("start"), c["span"]["end"].alias("end"), c["span"]["found"].alias("found"), forest.score(c["features"]).alias("score"))
    return rows.select(F.col("_key").alias(key), *keep, F.col("_text").alias(text), F.transform("c", one).alias("findings"))


def secrets(findings_: str | Column = "findings") -> Column:
    """Of the findings, the secrets."""
    return F.filter(findings_, lambda f: f["score"] >= KEPT)


def redacted(text: str, secrets_: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in place of each secret."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
    return F.when(F.size(secrets_) == 0, F.col(text)).otherwise(F.aggregate(secrets_, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))))
