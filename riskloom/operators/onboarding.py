"""A new core's files: which entity each file is, which column is which field, what codes mean, and checks of the result."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import decode, digits, full_match, zip5
from riskloom.operators.profile import overlap

#: Abbreviations and synonyms of words in column names.
WORDS = {"cust": "customer", "client": "customer", "member": "customer", "acct": "account", "nm": "name", "dt": "date", "ts": "time", "amt": "amount", "no": "number", "num": "number", "ref": "id", "cd": "code", "given": "first", "family": "last", "surname": "last", "postal": "zip", "mobile": "phone", "tel": "phone", "birth": "dob", "tax": "token", "ssn": "token", "posting": "transaction", "txn": "transaction", "posted": "transaction", "line": "street", "addr": "address"}
#: Fields of each entity with the words their columns' names have and the pattern their values have.
ENTITIES = {
    "customer": {"customer_id": ({"customer", "id"}, r".+"), "first_name": ({"first", "name"}, r"[A-Za-z' -]+"), "last_name": ({"last", "name"}, r"[A-Za-z' -]+"), "birth_date": ({"dob", "date"}, r"[0-9]{4}[-/]?[0-9]{2}[-/]?[0-9]{2}"), "token": ({"token", "id"}, r"[0-9A-Fa-f_-]{16,}|tkn_.+"), "zip": ({"zip", "code"}, r"[0-9]{5}"), "phone": ({"phone"}, r"[0-9+() -]{10,}"), "state": ({"state", "code"}, r"[A-Z]{2}")},
    "account": {"account_id": ({"account", "id"}, r".+"), "customer_id": ({"customer", "id"}, r".+"), "product": ({"account", "type"}, r"[A-Z]+"), "balance": ({"balance", "amount"}, r"-?[0-9]+(\.[0-9]+)?"), "status": ({"status", "code"}, r".{1,12}")},
    "transaction": {"txn_id": ({"transaction", "id"}, r".+"), "account_id": ({"account", "id"}, r".+"), "posted_at": ({"transaction", "time"}, r"[0-9]{10}|[0-9]{4}-.*"), "amount": ({"amount"}, r"-?[0-9]+(\.[0-9]+)?"), "txn_type": ({"type", "code"}, r"[A-Z]+")},
}


@dataclass
class Mapping:
    entity: str
    columns: dict[str, str] = field(default_factory=dict)
    review: list[str] = field(default_factory=list)


def name_tokens(column: str) -> set[str]:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column).replace("_", " ").lower().split()
    return {WORDS.get(w, w) for w in words}


def pattern_shares(df: DataFrame, columns: list[str]) -> dict[tuple[str, str, str], float]:
    """Share of non-empty values that have each field's pattern: one aggregate over the table."""
    aggs, keys = [], []
    for e, fields in ENTITIES.items():
        for f, (_, pattern) in fields.items():
            for c in columns:
                v = F.nullif(F.trim(c), F.lit(""))
                aggs.append(F.avg(F.when(v.isNotNull(), full_match(v, pattern).cast("double"))).alias(f"c{len(aggs)}"))
                keys.append((e, f, c))
    row = df.agg(*aggs).first()
    return {k: (v or 0.0) for k, v in zip(keys, row)}


def map_file(df: DataFrame, columns: list[str]) -> Mapping:
    """The entity whose fields fit most columns, best pairs first, each column once."""
    shares = pattern_shares(df, columns)
    best: tuple[float, Mapping] | None = None
    for e, fields in ENTITIES.items():
        pairs = []
        for f, (words, _) in fields.items():
            for i, c in enumerate(columns):
                own = name_tokens(c)
                hit = len(own & words)
                if hit and shares[e, f, c] >= 0.9:
                    pairs.append((hit + 0.25 * hit / len(own | words) + (0.5 if i == 0 and f == next(iter(fields)) else 0), f, c))
        m, total = Mapping(e), 0.0
        for s, f, c in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
            if f not in m.columns and c not in m.columns.values():
                m.columns[f] = c
                total += s
        m.review = [f for f in fields if f not in m.columns]
        if best is None or total > best[0]:
            best = (total, m)
    return best[1]


def discover_links(child: DataFrame, columns: list[str], parent: DataFrame, key: str, least: float = 0.9) -> list[tuple[str, float]]:
    found = [(c, overlap(child, c, parent, key).first()[0] or 0.0) for c in columns]
    return sorted([x for x in found if x[1] >= least], key=lambda x: -x[1])


def translate_codes(df: DataFrame, column: str, known: dict[str, str]) -> tuple[Column, list[str]]:
    """The decoded column, and codes for review that no vocabulary explains; they are never guessed."""
    seen = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(1000).collect()]
    return decode(F.col(column), known), [c for c in seen if c not in known]


def canonical_view(df: DataFrame, m: Mapping) -> DataFrame:
    """The file in the canonical shape; what isn't mapped is NULL."""
    out = []
    for f in ENTITIES[m.entity]:
        c = F.col(m.columns[f]) if f in m.columns else F.lit(None).cast("string")
        if f == "birth_date":
            c = F.coalesce(*[F.try_to_date(c, p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")])
        elif f == "zip":
            c = zip5(c)
        elif f == "phone":
            c = F.right(digits(c), F.lit(10))
        elif f == "token":
            c = F.lower(F.regexp_replace(F.regexp_replace(c, "^(?i)tkn_", ""), "-", ""))
        elif f in ("balance", "amount"):
            c = F.expr(f"try_cast({m.columns[f]} AS decimal(38,2))") if f in m.columns else c
        elif f == "posted_at":
            c = F.timestamp_seconds(c.try_cast("bigint"))
        out.append(c.alias(f))
    return df.select(*out, *[x for x in ("source_file", "source_row") if x in df.columns])


def checks(raw: DataFrame, view: DataFrame, m: Mapping) -> DataFrame:
    """Generated checks: rows, empty and repeated keys, values present in the file that didn't parse."""
    key = next(iter(ENTITIES[m.entity]))
    both = raw.select("source_file", "source_row", *[F.col(c).alias("_raw_" + f) for f, c in m.columns.items()]).join(view, ["source_file", "source_row"])
    aggs = [F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), (F.count(key) - F.countDistinct(key)).alias("repeated_keys")]
    aggs += [F.count_if(F.col(f).isNull() & F.col("_raw_" + f).isNotNull()).alias("not_parsed_" + f) for f in m.columns]
    return both.agg(*aggs)
