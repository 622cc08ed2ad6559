"""Entity resolution between two cores: standardise, block, compare, decide, link one to one.

Records have record_id, core, kind (PERSON or ORG), last_name, first_name, suffix, org_name, birth_date, token,
street_no, street_name, zip5, phone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.similarity import scored_pairs
from riskloom.functions.text import SUFFIXES, blank_to_null, clamp, clean_upper, party_key, phone10, reason_codes, street_name, street_number, zip5

FIELDS = ["record_id", "kind", "last_name", "first_name", "suffix", "org_name", "birth_date", "token", "street_no", "street_name", "zip5", "phone"]


def standard_a(raw: DataFrame) -> DataFrame:
    """First core: separate columns, dates YYYYMMDD, upper-case token."""
    person = F.col("CUST_TYPE") == "I"
    name = lambda c: F.when(person, clean_upper(F.col(c)))
    return raw.select(
        F.concat(F.lit("core_a:"), "CIF_NO").alias("record_id"), F.lit("core_a").alias("core"), F.col("CIF_NO").alias("source_key"),
        F.when(person, "PERSON").otherwise("ORG").alias("kind"), name("LAST_NM").alias("last_name"), name("FIRST_NM").alias("first_name"),
        name("MID_INIT").alias("middle"), name("SFX").alias("suffix"), F.when(~person, clean_upper(F.col("BUS_NM"))).alias("org_name"),
        F.try_to_date(F.nullif(F.col("BIRTH_DT"), F.lit("00000000")), "yyyyMMdd").alias("birth_raw"), F.lower(blank_to_null(F.col("TAX_ID_TKN"))).alias("token"),
        F.col("ADDR_LN1").alias("street"), clean_upper(F.col("CITY")).alias("city"), clean_upper(F.col("ST")).alias("state"), F.col("ZIP5").alias("zip_raw"), F.col("PHONE_NO").alias("phone_raw"),
    )


def standard_b(raw: DataFrame) -> DataFrame:
    """Second core: 'LAST, FIRST M SFX', dates MM/DD/YYYY, 'City, ST ZIP', token behind a prefix."""
    person = F.col("party_kind") == "PERSON"
    given = F.trim(F.split_part(F.col("full_name"), F.lit(","), F.lit(2)))
    word = lambda i: blank_to_null(F.upper(F.split_part(given, F.lit(" "), F.lit(i))))
    suffix = F.when(word(3).isin(SUFFIXES), word(3)).when(word(2).isin(SUFFIXES), word(2))
    tail = F.trim(F.split_part(F.col("city_state_zip"), F.lit(","), F.lit(2)))
    return raw.select(
        F.concat(F.lit("core_b:"), "party_uuid").alias("record_id"), F.lit("core_b").alias("core"), F.col("party_uuid").alias("source_key"),
        F.when(person, "PERSON").otherwise("ORG").alias("kind"), F.when(person, clean_upper(F.split_part(F.col("full_name"), F.lit(","), F.lit(1)))).alias("last_name"),
        F.when(person, word(1)).alias("first_name"), F.when(person & (F.length(word(2)) == 1), word(2)).alias("middle"), F.when(person, suffix).alias("suffix"),
        F.when(~person, clean_upper(F.col("full_name"))).alias("org_name"), F.try_to_date("dob", "MM/dd/yyyy").alias("birth_raw"),
        blank_to_null(F.regexp_replace(F.lower("ssn_token"), "^tkn_", "")).alias("token"), F.col("street"), clean_upper(F.split_part(F.col("city_state_zip"), F.lit(","), F.lit(1))).alias("city"),
        blank_to_null(F.split_part(tail, F.lit(" "), F.lit(1))).alias("state"), F.split_part(tail, F.lit(" "), F.lit(2)).alias("zip_raw"), F.col("phone_num").alias("phone_raw"),
    )


def standardise(a: DataFrame, b: DataFrame, as_of) -> DataFrame:
    """Both cores in one shape; dates after as_of or before 1900, and malformed ZIPs and phones, are NULL."""
    both = a.unionByName(b)
    ok = (F.col("birth_raw") <= F.lit(as_of)) & (F.year("birth_raw") >= 1900)
    person = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return both.withColumns({
        "display_name": F.coalesce("org_name", person), "birth_date": F.when(ok, F.col("birth_raw")), "street_no": street_number(F.col("street")),
        "street_name": street_name(F.col("street")), "zip5": zip5(F.col("zip_raw")), "phone": phone10(F.col("phone_raw")),
    })


def candidates(std: DataFrame) -> DataFrame:
    """Pairs of one record of each core that share a token, a birth date and surname initial, a birth date and
    ZIP, or a ZIP and surname: equi-joins on blocking keys, then distinct."""
    side = {c: std.where(F.col("core") == f"core_{c}").select(*[F.col(f).alias(f"{c}_{f}") for f in FIELDS], F.substring("last_name", 1, 1).alias(f"{c}_initial")) for c in "ab"}
    people = {c: d.where(F.col(f"{c}_kind") == "PERSON") for c, d in side.items()}
    keys = lambda *names: [F.col(f"a_{n}") == F.col(f"b_{n}") for n in names]
    blocks = [side["a"].join(side["b"], keys("token"))]
    blocks += [people["a"].join(people["b"], keys(*k)) for k in (("birth_date", "initial"), ("birth_date", "zip5"), ("zip5", "last_name"))]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out.dropDuplicates(["a_record_id", "b_record_id"])


def evidence(pairs: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Comparison flags of each candidate pair. nicknames: nickname, given (a small reference table)."""
    same = lambda n: F.coalesce(F.col(f"a_{n}") == F.col(f"b_{n}"), F.lit(False))
    both = lambda n: F.col(f"a_{n}").isNotNull() & F.col(f"b_{n}").isNotNull()
    p = scored_pairs(scored_pairs(pairs, "a_last_name", "b_last_name", "jw_last"), "a_first_name", "b_first_name", "jw_first")
    for i, (x, y) in enumerate((("a", "b"), ("b", "a"))):
        n = nicknames.select(F.col("nickname").alias(f"_n{i}"), F.col("given").alias(f"_g{i}"))
        p = p.join(n, (F.col(f"{x}_first_name") == F.col(f"_n{i}")) & (F.col(f"{y}_first_name") == F.col(f"_g{i}")), "left")
    p = p.withColumns({
        "tin_equal": same("token"), "tin_conflict": both("token") & ~same("token"), "tin_both": both("token"),
        "dob_equal": same("birth_date"), "dob_conflict": both("birth_date") & ~same("birth_date"), "dob_both": both("birth_date"),
        "edits": F.coalesce(F.levenshtein("a_last_name", "b_last_name"), F.lit(99)), "first_exact": same("first_name"),
        "nickname": F.col("_n0").isNotNull() | F.col("_n1").isNotNull(), "addr": same("street_no") & same("street_name"), "phone_equal": same("phone"),
        "suffix_conflict": both("suffix") & ~same("suffix"), "org_equal": same("org_name"), "kind_differs": F.col("a_kind") != F.col("b_kind"),
    }).drop("_n0", "_g0", "_n1", "_g1")
    return p.withColumns({"last_match": (F.col("jw_last") >= 88) | (F.col("edits") <= 1), "first_match": F.col("first_exact") | F.col("nickname") | (F.col("jw_first") >= 90)})


def _points() -> Column:
    plus = {"tin_equal": 40, "dob_equal": 25, "last_match": 10, "first_match": 10, "addr": 10, "phone_equal": 5, "tin_conflict": -60, "dob_conflict": -30, "suffix_conflict": -20}
    total = F.lit(0)
    for flag, n in plus.items():
        total = total + F.when(F.col(flag), n).otherwise(0)
    return clamp(total)


def decide(ev: DataFrame) -> DataFrame:
    """AUTO_LINK, REVIEW or REJECT by the first rule that applies; the score only orders and is shown."""
    c = F.col
    near = c("addr") | c("phone_equal")
    verdict = (
        F.when(c("kind_differs") | c("tin_conflict"), "REJECT")
        .when(c("a_kind") == "ORG", F.when(c("tin_equal"), "AUTO_LINK").when(c("org_equal"), "REVIEW").otherwise("REJECT"))
        .when(c("tin_equal") & c("dob_equal"), "AUTO_LINK")
        .when(c("tin_equal") & ~c("dob_both") & c("last_match"), "AUTO_LINK")
        .when(c("tin_equal"), "REVIEW")
        .when(c("dob_equal") & c("last_match") & c("first_match") & near & ~c("suffix_conflict"), "AUTO_LINK")
        .when(c("dob_equal") & c("last_match"), "REVIEW")
        .when(c("last_match") & c("first_match") & near, "REVIEW")
        .when(c("dob_equal") & c("first_match") & c("addr") & c("phone_equal"), "REVIEW")
        .otherwise("REJECT")
    )
    tags = [("tin_equal", "TIN"), ("dob_equal", "DOB"), ("last_match", "LAST"), ("first_match", "FIRST"), ("addr", "ADDR"), ("phone_equal", "PHONE"), ("tin_conflict", "TIN_CONFLICT"), ("dob_conflict", "DOB_CONFLICT"), ("suffix_conflict", "SUFFIX_CONFLICT")]
    return ev.withColumns({"score": _points(), "decision": verdict, "reason_codes": reason_codes([(c(f), t) for f, t in tags])})


def mutual_best(decided: DataFrame) -> DataFrame:
    """One-to-one links: pairs that are the best automatic link of both their records."""
    auto = decided.where(F.col("decision") == "AUTO_LINK").select(F.col("a_record_id").alias("a_id"), F.col("b_record_id").alias("b_id"), "score", "reason_codes")
    a = Window.partitionBy("a_id").orderBy(F.desc("score"), "b_id")
    b = Window.partitionBy("b_id").orderBy(F.desc("score"), "a_id")
    return auto.withColumns({"_ra": F.row_number().over(a), "_rb": F.row_number().over(b)}).where("_ra = 1 AND _rb = 1").drop("_ra", "_rb")


def party_xref(std: DataFrame, links: DataFrame) -> DataFrame:
    """Each record's party; a linked pair's is keyed by the first core's record."""
    a = links.select(F.col("a_id").alias("_a"), F.col("score").alias("_sa"))
    b = links.select(F.col("b_id").alias("_b"), F.col("a_id").alias("_anchor"), F.col("score").alias("_sb"))
    j = std.join(a, F.col("record_id") == F.col("_a"), "left").join(b, F.col("record_id") == F.col("_b"), "left")
    linked = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    anchor = F.coalesce("_anchor", "record_id")
    return j.select("record_id", "core", "source_key", party_key(anchor).alias("party_id"), F.when(linked, "LINKED").otherwise("SINGLE").alias("link_status"), F.coalesce("_sa", "_sb").alias("link_score"))


def review_queue(decided: DataFrame, links: DataFrame) -> DataFrame:
    """Uncertain pairs of which neither record is linked."""
    open_ = decided.where(F.col("decision") == "REVIEW")
    open_ = open_.join(links.select(F.col("a_id").alias("a_record_id")), "a_record_id", "left_anti").join(links.select(F.col("b_id").alias("b_record_id")), "b_record_id", "left_anti")
    why = F.when(F.col("tin_equal"), "same tax token, birth dates differ").when(F.col("dob_equal") & F.col("last_match"), "same birth date and surname").when(F.col("org_equal"), "same organisation name").otherwise("similar name and contact")
    return open_.select("a_record_id", "b_record_id", "score", "reason_codes", why.alias("review_reason"))
