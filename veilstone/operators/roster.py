"""The roster: who takes part in a mail collection, under which names, with whom.

Only header columns are read; message texts are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email.utils import getaddresses

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ADDRESS = r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
HEADERS = ("mail_id", "mail_from", "mail_to", "cc", "x_from", "x_to", "x_cc", "custodian", "ts")
#: Upper ends of the message-count buckets (fixed values).
BUCKETS = (("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), ("10-49", 10, 49), ("50+", 50, None))
PERCENTILES = (25, 50, 75, 90)


def addresses(field: Column, is_list: bool) -> Column:
    """The bare addresses of a header, lower-cased, in order; a list that was cut at commas is
    joined again first."""
    text = F.array_join(field, ", ") if is_list else field
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({ADDRESS})"), 1), F.array().cast("array<string>"))


def parse_addresses(value: str | list[str] | None) -> list[tuple[str, str]]:
    """(display name, address) of a header by the rules of mail addresses. A list that was cut at
    commas is joined again first; an address is in lower case; a name that only repeats its
    address is ''. Where the rules find nothing, any address in the text counts, without a name."""
    text = value if isinstance(value, str) else ", ".join(v for v in value or [] if v)
    out = []
    for name, address in getaddresses([text], strict=False):
        address = address.strip().lower()
        if "@" in address:
            shown = " ".join(name.split()).strip("'\"")
            out.append(("" if shown.lower() == address else shown, address))
    return out or [("", a) for a in dict.fromkeys(re.findall(ADDRESS, text.lower()))]


def address_entries(mail: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, pos, name, address): parse_addresses of header fields, strings or lists, in
    Arrow batches; pos counts from 1. Null and empty headers give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for c, field in enumerate(fields, 1):
                for i, value in enumerate(batch.column(c).to_pylist()):
                    found = parse_addresses(value) if value else []
                    take += [i] * len(found)
                    rows += [(field, n, *entry) for n, entry in enumerate(found, 1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *columns], names=[key, "field", "pos", "name", "address"])

    return mail.select(key, *fields).mapInArrow(run, f"{key} {mail.schema[key].dataType.simpleString()}, field string, pos int, name string, address string")


def x_entries(header: Column) -> Column:
    """array<struct<name, login>> of a typed header's `name <distinguished name>` entries; the
    login is the last CN=, lower-cased, '' if there is none."""
    flat = F.trim(F.regexp_replace(header, r"\s+", " "))
    names = F.regexp_extract_all(flat, F.lit(r"([^<>]*)<([^<>]*)>"), 1)
    dns = F.regexp_extract_all(flat, F.lit(r"([^<>]*)<([^<>]*)>"), 2)
    clean = lambda n: F.trim(F.regexp_replace(F.trim(n), r"^[\s,;'\"]+|['\"\s]+$", ""))
    zipped = F.zip_with(names, dns, lambda n, d: F.struct(clean(n).alias("name"), F.lower(F.regexp_extract(d, r"(?i)CN=([^/=]+)$", 1)).alias("login")))
    return F.coalesce(zipped, F.array().cast("array<struct<name:string,login:string>>"))


def participants(mail: DataFrame) -> DataFrame:
    """(mail_id, role, address, name, login, ts, custodian): one row per address in a header.

    Names and logins come from the typed header at the same place, if both headers have
    equally many entries; else they are ''. Null headers give no rows.
    """
    def header(role: str, field: str, x: str, is_list: bool) -> Column:
        found, typed = addresses(F.col(field), is_list), x_entries(F.col(x))
        blank = F.transform(found, lambda a: F.struct(F.lit("").alias("name"), F.lit("").alias("login")))
        paired = F.when(F.size(found) == F.size(typed), typed).otherwise(blank)
        return F.zip_with(found, paired, lambda a, t: F.struct(F.lit(role).alias("role"), a.alias("address"), F.coalesce(t["name"], F.lit("")).alias("name"), F.coalesce(t["login"], F.lit("")).alias("login")))

    every = F.concat(header("from", "mail_from", "x_from", False), header("to", "mail_to", "x_to", True), header("cc", "cc", "x_cc", True))
    return mail.select("mail_id", "ts", "custodian", F.explode(every).alias("p")).select("mail_id", "p.role", "p.address", "p.name", "p.login", "ts", "custodian")


def co_occurrence(people: DataFrame) -> DataFrame:
    """(address, other, messages): in how many mails two different addresses stand together.
    Pairs are built inside a mail's own address set, so nothing is joined."""
    sets = people.groupBy("mail_id").agg(F.collect_set("address").alias("a"))
    pairs = sets.select(F.explode("a").alias("address"), "a").select("address", F.explode("a").alias("other")).filter("address <> other")
    return pairs.groupBy("address", "other").agg(F.count("*").alias("messages"))


def top_correspondents(people: DataFrame, top: int = 5) -> DataFrame:
    """(address, rank, other, messages): the `top` most frequent of each, ties by address."""
    return _most(co_occurrence(people), top)


def _most(edges: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("address").orderBy(F.desc("messages"), "other")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("address", "rank", "other", "messages")


def name_variants(people: DataFrame) -> DataFrame:
    """(address, name, uses): how often each name stands beside an address."""
    return people.filter("name <> ''").groupBy("address", "name").agg(F.count("*").alias("uses"))


def entries(people: DataFrame, domain: str, top: int = 5) -> DataFrame:
    """One row per address: message, sent and received counts (a sender of a mail does not also
    receive it), names by use, logins, custodians, active window, correspondents."""
    per_mail = people.groupBy("mail_id", "address").agg(F.max((F.col("role") == "from").cast("int")).alias("sent"), F.first("ts").alias("ts"), F.first("custodian").alias("custodian"))
    counts = per_mail.groupBy("address").agg(
        F.count("*").alias("message_count"), F.sum("sent").alias("sent_count"), F.sum(1 - F.col("sent")).alias("received_count"),
        F.min("ts").alias("active_from"), F.max("ts").alias("active_to"), F.array_sort(F.collect_set("custodian")).alias("custodians"),
    )
    names = name_variants(people).groupBy("address").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("uses")).alias("u"), F.col("name")))), lambda x: x["name"]).alias("display_name_variants"))
    logins = people.filter("login <> ''").groupBy("address").agg(F.array_sort(F.collect_set("login")).alias("exchange_logins"))
    edges = written(co_occurrence(people), "edges")
    others = edges.groupBy("address").agg(F.count("*").alias("distinct_correspondents"))
    best = _most(edges, top).groupBy("address").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "messages"))), lambda x: F.struct(x["other"].alias("address"), x["messages"].alias("messages"))).alias("top_correspondents"))
    none = F.array().cast("array<string>")
    return (
        counts.join(names, "address", "left").join(logins, "address", "left").join(others, "address", "left").join(best, "address", "left")
        .withColumn("display_name_variants", F.coalesce("display_name_variants", none)).withColumn("exchange_logins", F.coalesce("exchange_logins", none))
        .withColumn("distinct_correspondents", F.coalesce("distinct_correspondents", F.lit(0)))
        .withColumn("internal", F.col("address").endswith("@" + domain))
    )


def _first_filled(names: Column, part) -> Column:
    found = F.filter(F.transform(names, lambda n: part(F.trim(F.regexp_replace(n, r"(?U)\s+", " ")))), lambda x: x != "")
    return F.coalesce(F.get(found, 0), F.lit(""))


def surname(names: Column) -> Column:
    """The surname by the first of a list of display names that has one: what stands before a
    comma, else the last of several words; '' if no name has one."""
    return _first_filled(names, lambda n: F.when(F.contains(n, F.lit(",")), F.trim(F.substring_index(n, ",", 1))).when(F.contains(n, F.lit(" ")), F.substring_index(n, " ", -1)).otherwise(""))


def given_name(names: Column) -> Column:
    """The first name likewise: the first word behind a comma, else the first of several words."""
    behind = lambda n: F.substring_index(F.trim(F.regexp_replace(n, "^[^,]*,", "")), " ", 1)
    return _first_filled(names, lambda n: F.when(F.contains(n, F.lit(",")), behind(n)).when(F.contains(n, F.lit(" ")), F.substring_index(n, " ", 1)).otherwise(""))


def usable(roster: DataFrame, min_messages: int = 20) -> DataFrame:
    """Entries with a name, both ends of the active window and enough messages."""
    return roster.filter((F.size("display_name_variants") > 0) & F.col("active_from").isNotNull() & F.col("active_to").isNotNull() & (F.col("message_count") >= min_messages))


def percentiles(counts: DataFrame, value: str, wanted: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """One row p25, p50 ...: nearest-rank percentiles with half-even rounding of the rank, from
    a count by value; 0 for no rows."""
    table = counts.groupBy(value).agg(F.count("*").alias("c"))
    total = table.agg(F.sum("c")).first()[0]
    if not total:
        return counts.sparkSession.createDataFrame([tuple(0 for _ in wanted)], ", ".join(f"p{p} bigint" for p in wanted))
    # values are few after counting; the running sum is one window over the counted table
    running = table.withColumn("upto", F.sum("c").over(Window.orderBy(value)))
    rank = lambda p: F.greatest(F.lit(1), F.least(F.lit(int(total)), F.bround(F.lit(p / 100.0 * total), 0).cast("long")))
    return running.agg(*(F.min(F.when(F.col("upto") >= rank(p), F.col(value))).cast("long").alias(f"p{p}") for p in wanted))


def histogram(counts: DataFrame, value: str) -> DataFrame:
    """(bucket, people): message counts by bucket, empty buckets included; 0 is in none."""
    inside = [F.count_if((F.col(value) >= lo) & (F.col(value) <= hi if hi else F.lit(True))).alias(name) for name, lo, hi in BUCKETS]
    one = counts.agg(*inside)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("people")) for n, _, _ in BUCKETS))).alias("b")).select("b.bucket", "b.people")


def coverage(roster: DataFrame, scanned: int, min_messages: int = 20) -> DataFrame:
    """One row of counts and shares about a roster."""
    share = lambda c: F.round(F.when(F.col("people") > 0, 100.0 * c / F.col("people")).otherwise(0.0), 1)
    one = roster.agg(
        F.count("*").alias("people"), F.count_if(F.size("display_name_variants") > 0).alias("named"), F.count_if(F.size("exchange_logins") > 0).alias("with_login"), F.count_if("internal").alias("internal"),
        F.coalesce(F.min("message_count"), F.lit(0)).alias("least"), F.coalesce(F.max("message_count"), F.lit(0)).alias("most"), F.round(F.coalesce(F.avg("message_count"), F.lit(0.0)), 2).alias("mean"),
        F.count_if((F.size("display_name_variants") > 0) & F.col("active_from").isNotNull() & F.col("active_to").isNotNull() & (F.col("message_count") >= min_messages)).alias("usable"),
    )
    return one.select(F.lit(scanned).cast("long").alias("scanned"), "*", share(F.col("named")).alias("named_percent"), share(F.col("with_login")).alias("login_percent"))


def go_no_go(cov: DataFrame, min_subjects: int = 5) -> DataFrame:
    return cov.select("usable", F.when(F.col("usable") >= min_subjects, "go").otherwise("no_go").alias("decision"))
