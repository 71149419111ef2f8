"""The registered queries of the pseudonymization engine and their DuckDB equivalents.

Kinds that the tables do not hold are written into text from key columns, by the same
expression in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as X
from ..operators import allocate as A
from ..operators import reports as R
from ..operators.options import Options
from ..sources import commit_gate, files, staging
from .cut import cut, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ALLOW = ["noreply@example.org", "system", "guest"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def found(df: DataFrame, key: str, values) -> DataFrame:
    """A row per value, numbered in order of appearance."""
    return df.select(F.col(key), F.posexplode(values).alias("pos", "value")).select(key, F.col("pos").cast("long").alias("pos"), "value")


def find_sql(source: str, key: str, array: str) -> str:
    """The same in DuckDB, for an expression that yields a list."""
    return f"with s as (select {key}, {array} as v from ({source})) select {key}, cast(i - 1 as bigint) as pos, v[i] as value from s, unnest(range(1, len(v) + 1)) as t(i)"


EMAILS_SQL = f"regexp_extract_all(text, {q('(?i)' + X.EMAIL)})"


# --- detectors on the tables --------------------------------------------------------------------
@query(find_sql("select doc_id, text from documents where text is not null", "doc_id", EMAILS_SQL))
def email_find(spark, sf_dir):
    return found(table(spark, sf_dir, "documents"), "doc_id", C.emails(F.col("text")))


@query(find_sql("select page_id, html as text from pages where html is not null", "page_id", EMAILS_SQL))
def email_find_pages(spark, sf_dir):
    return found(table(spark, sf_dir, "pages"), "page_id", C.emails(F.col("html")))


IPV4_SQL = (
    r"list_filter(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b'),"
    r" lambda v: not regexp_matches(v, '^(127\.|0\.0\.0\.0$|203\.0\.113\.)') and not regexp_matches(v, '(^|\.)0[0-9]'))"
)


@query(find_sql("select page_id, html as text from pages where html is not null", "page_id", IPV4_SQL))
def ipv4_find(spark, sf_dir):
    return found(table(spark, sf_dir, "pages"), "page_id", C.ipv4s(F.col("html")))


@query("select doc_id, cast(len(list_filter(" + EMAILS_SQL + f", lambda v: not lower(v) like '%@example.test' and lower(v) not in ({', '.join(map(q, ALLOW))}))) as bigint) as residual_email from documents where text is not null")
def email_residual(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(C.residual_emails(F.col("text"), ALLOW)).cast("long").alias("residual_email"))


FIRST_EMAIL_SQL = f"""
with f as ({find_sql("select doc_id, text from documents where text is not null", "doc_id", EMAILS_SQL)}),
k as (select lower(value) as key, min(struct_pack(d := doc_id, p := pos)) as s from f where lower(value) not like '%@example.test' group by 1),
n as (select key, row_number() over (order by s, key) as n from k)
select key, cast(n as integer) as n, case when key like 'uhmaskedaddr\\_%' escape '\\' then 'UHMASKEDADDR_' else '' end || 'user_' || printf('%03d', n) || '@example.test' as token from n"""


def _email_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' addresses, and the map that they give."""
    rows = found(table(spark, sf_dir, "documents"), "doc_id", C.residual_emails(F.col("text")))
    rows = cut(rows.select(F.col("doc_id").alias("file_ord"), F.lit(2).alias("pass"), "pos", F.lit("email").alias("kind"), F.lower("value").alias("key"), "value"))  # found once, read twice
    return rows, A.allocate(rows, A.empty_map(spark))


@query(FIRST_EMAIL_SQL)
def email_allocate(spark, sf_dir):
    return _email_map(spark, sf_dir)[1].select("key", "n", "token")


@query(f"""
with m as ({FIRST_EMAIL_SQL}), f as ({find_sql("select doc_id, text from documents where text is not null", "doc_id", EMAILS_SQL)}),
h as (select doc_id, count(*) as n, string_agg(token, ',' order by pos) as tokens from f join m on lower(value) = key group by doc_id)
select d.doc_id, coalesce(h.n, 0)::bigint as hits, coalesce(tokens, '') as tokens, cast(length(regexp_replace(coalesce(text, ''), {q('(?i)' + X.EMAIL)}, '', 'g')) as bigint) as rest_chars
from documents d left join h using (doc_id)""")
def email_scrub(spark, sf_dir):
    """Every document with its replacements, and how much of its text is not addresses."""
    docs = table(spark, sf_dir, "documents")
    rows, pii_map = _email_map(spark, sf_dir)
    tokens = rows.join(pii_map.select("key", "token"), "key").groupBy(F.col("file_ord").alias("doc_id"))
    tokens = tokens.agg(F.count("*").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), ",").alias("tokens"))
    text = F.coalesce("text", F.lit(""))
    rest = F.length(F.when(text.contains("@"), F.regexp_replace(text, C.rx(X.EMAIL, "i"), "")).otherwise(text)).cast("long")
    return docs.join(tokens, "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("tokens", F.lit("")).alias("tokens"), rest.alias("rest_chars"))


@query()
def scrub_documents(spark, sf_dir):
    """The whole engine over the documents: lengths before and after, hits and residuals of each."""
    from ..operators.scrub import scrub

    run = scrub(table(spark, sf_dir, "documents"), None, Options(allowlist=frozenset(ALLOW), ip=True, nl_id=True).technical(), ord_col="doc_id")
    hits = run.hits.groupBy("file_ord").agg(F.count("*").alias("hits"))
    rest = run.residuals.groupBy("file_ord").agg(F.count("*").alias("residual"))
    docs = run.documents.select("file_ord", F.length("original").alias("chars_before"), F.length("text").alias("chars_after"))
    return docs.join(hits, "file_ord", "left").join(rest, "file_ord", "left").na.fill(0)


# --- detectors on text made from keys --------------------------------------------------------------
def customers(spark: SparkSession, sf_dir: str, text, key: str = "id") -> DataFrame:
    """A text per customer; keys are spread before it is made."""
    keys = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return keys.select(F.col("c_custkey").alias(key), text.alias("text"))


def customers_sql(text: str) -> str:
    return f"select c_custkey as id, {text} as text from customer"


def made(name: str, spark_text: str, array_sql: str, detect) -> None:
    """Register a detector over text made from customer keys by one SQL expression in both engines."""

    def run(spark, sf_dir):
        return found(customers(spark, sf_dir, F.expr(spark_text)), "id", detect(F.col("text")))

    run.__name__ = name
    query(find_sql(customers_sql(spark_text), "id", array_sql))(run)


K9 = "lpad(cast(c_custkey as string), 9, '0')"
_VALID_BSN = "list_filter({v}, lambda x: length(x) between 8 and 9 and lpad(x, 9, '0') <> '000000000' and (list_sum([cast(substr(lpad(x, 9, '0'), i, 1) as integer) * (10 - i) for i in range(1, 9)]) - cast(substr(lpad(x, 9, '0'), 9, 1) as integer)) % 11 = 0)"
made("bsn_valid", f"concat('bsn: ', {K9}, ' x')", _VALID_BSN.format(v=r"regexp_extract_all(text, '(?i)\b(?:bsn|burgerservicen(?:ummer)?)\b\s*[:=]?\s*(\d{8,9})\b', 1)"), C.bsns)
made("bsn_bare_find", f"concat('nr ', {K9}, ' of 1', {K9})", _VALID_BSN.format(v=r"regexp_extract_all(text, '(?:^|[^0-9])([0-9]{{9}})(?:[^0-9]|$)', 1)".replace("{{", "{").replace("}}", "}")), lambda t: C.bsns(t, bare=True))
made("path_windows_find", "concat('at C:', chr(92), 'Users', chr(92), 'u', cast(c_custkey as string), chr(92), 'x.log end')", r"regexp_extract_all(text, '[A-Za-z]:\\[^\s]+')", C.paths)
made("mac_find", f"concat('mac 00:1B:44:', substr({K9}, 4, 2), ':', substr({K9}, 6, 2), ':', substr({K9}, 8, 2), ' end')", r"regexp_extract_all(text, '\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b')", C.macs)
made("phone_find", f"concat('tel +31 6 ', substr({K9}, 2, 8), ' of 06-', substr({K9}, 2, 8))", r"regexp_extract_all(text, '(?:\+31[\s\-.]?(?:\d[\s\-.]?){8,9}\d|0\d[\s\-.]?(?:\d[\s\-.]?){7,8}\d)')", C.phones)
made("postcode_find", f"concat('Kerkstraat ', cast(c_custkey % 90 + 1 as string), ', ', cast(1000 + c_custkey % 8999 as string), ' AB end')", r"regexp_extract_all(text, '(?i)\b([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-'']{2,40}\s+\d{1,5}[a-zA-Z]?)\s*,?\s*([1-9]\d{3}\s?[A-Za-z]{2})\b')", C.street_postcodes)
made("postcode_bare_find", "concat('at ', cast(1000 + c_custkey % 8999 as string), ' AB and ', cast(1000 + c_custkey % 7 as string), 'CD')", r"regexp_extract_all(text, '\b([1-9]\d{3}\s?[A-Za-z]{2})\b', 1)", C.bare_postcodes)
made("dob_find", "concat('dob: ', cast(1930 + c_custkey % 70 as string), '-0', cast(c_custkey % 9 + 1 as string), '-1', cast(c_custkey % 10 as string), '; Date of Birth = 1-2-1990')", r"regexp_extract_all(text, '(?i)\b(?:dob|date\s*of\s*birth|geboortedatum|birth\s*date)\b\s*[:=]?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})', 1)", C.dobs)
made("machine_find", "concat('hostname: srv-', cast(c_custkey as string), '.local host=MACHINE_001')", r"list_filter(regexp_extract_all(text, '(?i)(\b(?:hostname|host|machine(?:-|\s)?name|computer(?:\s+name)?)\s*[:=]\s*)([A-Za-z0-9][A-Za-z0-9._-]{0,62})', 2), lambda v: not regexp_matches(upper(v), '^(MACHINE_|PATH_|CMD_|CERT_)'))", C.machines)
made("path_find", "concat('see /home/u', cast(c_custkey as string), '/x.log and /tmp/a', cast(c_custkey % 9 as string), '.txt end')", r"regexp_extract_all(text, '(/(?:home|Users|tmp|opt|var|mnt)/[^\s""''<>|\r\n]+)', 1)", C.paths)
made("cmd_find", "concat('note\n$ git push ', cast(c_custkey as string), '\nplain\npython -3 run.py ')", r"list_transform(regexp_extract_all(text, '(?im)^(?:[\$>]+\s*)?(?:py(?:thon)?(?:\s+-3)?|powershell|pwsh|Get-Content|curl|git|npm|node|bash|sh)\b[^\n]{0,500}'), lambda v: trim(v))", C.commands)
made("pem_find", "concat('a\n-----BEGIN KEY-----\n', cast(c_custkey as string), '\n-----END KEY-----\nb')", r"regexp_extract_all(text, '(?ms)^-----BEGIN [A-Z0-9 ]+-----\r?\n(?:.*?\r?\n)??-----END [A-Z0-9 ]+-----(?:\r?\n|\z)')", C.pems)
made("audit_user_xml", "concat('<sys_created_by>user', cast(c_custkey as string), '</sys_created_by>')", r"regexp_extract_all(text, '(?i)(<(?:sys_created_by|sys_updated_by)>)([^<]+)(</(?:sys_created_by|sys_updated_by)>)', 2)", C.audit_users_xml)
made("audit_user_json", "concat('{\"sys_updated_by\": \"user', cast(c_custkey as string), '\"}')", r"""regexp_extract_all(text, '(?i)("(?:sys_created_by|sys_updated_by)"\s*:\s*")([^"]+)(")', 2)""", C.audit_users_json)
made("name_angle", "concat('Jan Jansen <user', cast(c_custkey as string), '@corp.example>')", r"regexp_extract_all(text, '(?i)([A-Za-z][A-Za-z0-9 .''_-]{0,80}?)\s*<\s*([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,63})\s*>', 1)", lambda t: F.transform(C.named_addresses(t), lambda p: p["display"]))
#: A person's name from a nation's number.
PERSON = "concat('Sam ', chr(cast(65 + n_nationkey % 26 as int)), 'arsen')"


#: A person's name of a customer's own.
CUSTOMER = "concat('Sam ', chr(cast(65 + c_custkey % 26 as int)), 'arsen', chr(cast(97 + floor(c_custkey / 26) % 26 as int)), chr(cast(97 + floor(c_custkey / 676) % 26 as int)), chr(cast(97 + floor(c_custkey / 17576) % 26 as int)), chr(cast(97 + floor(c_custkey / 456976) % 26 as int)))"


def of_customers(expr: str) -> str:
    """An expression over nations, over customers; ``n`` is a customer's place by key."""
    return expr.replace(PERSON, CUSTOMER).replace("n_nationkey + 1", "n").replace("n_nationkey", "c_custkey")


def nations(spark: SparkSession, sf_dir: str, text: str, detect) -> DataFrame:
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.expr(text).alias("text"))
    return found(df, "id", detect(F.col("text")))


def harvested(name: str, text: str, detect, names: str) -> None:
    """A harvester over text made from nation numbers; ``names`` lists what must come out."""

    def run(spark, sf_dir):
        return nations(spark, sf_dir, text, detect)

    run.__name__ = name
    query(find_sql(f"select n_nationkey as id, {names} as text from nation", "id", "text"))(run)

    def run_customers(spark, sf_dir):
        return found(customers(spark, sf_dir, F.expr(of_customers(text))), "id", detect(F.col("text")))

    run_customers.__name__ = f"{name}_customers"
    query(find_sql(customers_sql(of_customers(names)), "id", "text"))(run_customers)


harvested("harvest_table", f"concat('| Reporter | - ', {PERSON}, ' / Ann Other |\n| Text | Not This |')", C.harvest_table, f"[{PERSON}, 'Ann Other']")
harvested("harvest_bullets", f"concat('**Stakeholders:**\n- ', {PERSON}, ', Ann Other\n* Casey van Berg\n\nNotes:\n- Not This')", C.harvest_bullets, f"[{PERSON}, 'Ann Other', 'Casey van Berg']")
harvested("harvest_test_with", f"concat('Tested with ', {PERSON}, ' and Ann Other: fine')", C.harvest_test_with, f"[{PERSON}, 'Ann Other']")
harvested("harvest_xml", f"concat('<opened_by display_value=\"', {PERSON}, '\">x</opened_by><group display_value=\"Not This\">')", C.harvest_xml, f"[{PERSON}]")
harvested("harvest_json", f"concat('{{\"caller_id\": {{\"value\": \"1\", \"display_value\": \"', {PERSON}, '\"}}}}')", C.harvest_json, f"[{PERSON}]")


@query("""
select c_custkey as id, cast(0 as bigint) as pos,
  'NL' || printf('%02d', (98 - cast('10112310' || lpad(c_custkey::varchar, 10, '0') || '232100' as hugeint) % 97)::integer) || 'ABNA' || lpad(c_custkey::varchar, 10, '0') as value
from customer""")
def iban_valid(spark, sf_dir):
    """IBANs with computed check digits are found, in compact form."""
    acct = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    rest = F.concat(F.lit("10112310"), acct, F.lit("232100")).cast("decimal(38,0)") % F.lit(97)
    iban = F.concat(F.lit("NL"), F.format_string("%02d", (F.lit(98) - rest).cast("int")), F.lit("ABNA"), acct)
    return found(customers(spark, sf_dir, F.concat(F.lit("to "), iban, F.lit(" now"))), "id", C.ibans(F.col("text")))


# --- predicates ---------------------------------------------------------------------------------------
SAMPLES = ["Jane Doe", "Casey van Berg", "Kostenplaats", "Dustin", "WPO", "4 people", "INC0871657", "PERSON_001", "user_001@example.test", "username_9", "ORG_1 ", "John F. Kennedy", "", "Not A Name Because Too Many Words", "jane Doe", "CERT_", "redacted_email_0af3"]
NAMES_TRUE, TOKENS_TRUE = ["Jane Doe", "Casey van Berg"], ["PERSON_001", "user_001@example.test", "username_9", "ORG_1 ", "redacted_email_0af3"]


def _values(values: list[str]) -> str:
    return "(values " + ", ".join(f"({i}, {q(v)})" for i, v in enumerate(values)) + ") as t(id, v)"


@query(f"select cast(id as bigint) as id, v in ({', '.join(map(q, NAMES_TRUE))}) as is_name, v in ({', '.join(map(q, TOKENS_TRUE))}) as is_token from {_values(SAMPLES)}")
def predicates(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id long, v string")
    return df.select("id", C.looks_like_name(F.col("v")).alias("is_name"), C.is_token(F.col("v")).alias("is_token"))


@query("select doc_id, sha256(coalesce(text, '')) as sha256 from documents")
def doc_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", staging.file_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("sha256"))


def _clerk():
    return F.concat(F.lit("Clerk#"), (F.col("o_custkey") % 1000).cast("string"))


# --- allocation and dictionaries -------------------------------------------------------------------------
@query("""
with f as (select o_orderkey as ord, lower('Clerk#' || (o_custkey % 1000)) as key from orders),
k as (select key, min(ord) as ord from f group by key)
select key, cast(row_number() over (order by ord, key) as integer) as n, 'username_' || printf('%03d', row_number() over (order by ord, key)) as token from k""")
def username_allocate(spark, sf_dir):
    """Clerks numbered by the first order that names them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("file_ord"), F.lit(3).alias("pass"), F.lit(0).cast("long").alias("pos"), F.lit("username").alias("kind"), F.lower(_clerk()).alias("key"), _clerk().alias("value"))
    return A.allocate(rows, A.empty_map(spark)).select("key", "n", "token")


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    ip = F.concat(F.lit("10."), F.pmod(F.floor(n / 65536), F.lit(256)), F.lit("."), F.pmod(F.floor(n / 256), F.lit(256)), F.lit("."), F.pmod(n, F.lit(256)))
    return table(spark, sf_dir, "customer").select(n.cast("long").alias("file_ord"), F.lit(12).alias("pass"), F.lit(0).cast("long").alias("pos"), F.lit("ip").alias("kind"), ip.alias("key"), ip.alias("value"))


IP_SQL = "select c_custkey, '10.' || (c_custkey // 65536 % 256) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) as key, row_number() over (order by c_custkey) as n from customer"


@query(f"select key, cast(n as integer) as n, '203.0.113.' || (n % 254 + 1) as token from ({IP_SQL})")
def ip_wrap(spark, sf_dir):
    return A.allocate(_ips(spark, sf_dir), A.empty_map(spark)).select("key", "n", "token")


@query(f"select '203.0.113.' || (n % 254 + 1) as token, cast(count(*) as bigint) as candidates from ({IP_SQL}) group by 1")
def map_reverse(spark, sf_dir):
    pii_map = A.allocate(_ips(spark, sf_dir), A.empty_map(spark))
    return A.reverse(pii_map, pii_map).select("token", F.size("values").cast("long").alias("candidates"))


NAMES = ["Sam Jansen", "SAM JANSEN", "Ann van Berg", "Sam Other", "Not Ann"]


def _names(spark: SparkSession) -> DataFrame:
    rows = [(i, 6, 0, "person", n, n) for i, n in enumerate(NAMES)]
    return A.allocate(spark.createDataFrame(rows, A.FOUND), A.empty_map(spark))


@query("select * from (values ('Sam Jansen', 'PERSON_001'), ('SAM JANSEN', 'PERSON_001'), ('Ann van Berg', 'PERSON_002'), ('Sam Other', 'PERSON_003'), ('Not Ann', 'PERSON_004')) t(key, token)")
def name_case_alias(spark, sf_dir):
    return _names(spark).select("key", "token")


@query("""select * from (values ('Sam Jansen', 'PERSON_001'), ('SAM JANSEN', 'PERSON_001'), ('Ann van Berg', 'PERSON_002'), ('Sam Other', 'PERSON_003'), ('Not Ann', 'PERSON_004'),
('Sam', 'PERSON_001'), ('Jansen', 'PERSON_001'), ('JANSEN', 'PERSON_001'), ('Ann', 'PERSON_002'), ('Berg', 'PERSON_002'), ('Other', 'PERSON_003')) t(key, token) where key <> 'Other'""")
def name_expand(spark, sf_dir):
    return A.expand_names(_names(spark)).select("key", "token")


@query("""
with w as (select distinct doc_id, lower(w) as w from documents, unnest(regexp_extract_all(text, '[A-Za-z]+')) as t(w)),
f as (select w, min(doc_id) as ord from w where length(w) >= 6 group by w having count(*) >= 3)
select a.w as word, cast(count(*) as bigint) as visible_docs from f a join w on w.w = a.w and a.ord <= w.doc_id group by a.w""")
def visibility_sequential(spark, sf_dir):
    """A dictionary entry serves from the document on in which it was first seen."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.expr("transform(regexp_extract_all(text, '[A-Za-z]+', 0), x -> lower(x))"))).alias("w"))
    entries = words.filter(F.length("w") >= 6).groupBy("w").agg(F.min("doc_id").alias("ord"), F.count("*").alias("n")).filter("n >= 3")
    return words.join(entries.select("w", "ord"), "w").filter("ord <= doc_id").groupBy(F.col("w").alias("word")).agg(F.count("*").alias("visible_docs"))


# --- counts and gates --------------------------------------------------------------------------------------
def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("email", "name", "org", "username")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    words = F.element_at(F.array(*[F.lit(w) for w in ("test", "Sam", "Esprit")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return orders.select((F.col("o_orderkey") % 50).cast("long").alias("file_ord"), kind.alias("kind"), words.alias("original"), _clerk().alias("replacement"))


HITS_SQL = "select o_orderkey % 50 as file_ord, ['email', 'name', 'org', 'username'][cast(o_orderkey % 4 + 1 as integer)] as kind, ['test', 'Sam', 'Esprit'][cast(o_custkey % 3 + 1 as integer)] as original, 'Clerk#' || (o_custkey % 1000) as replacement from orders"


@query(f"select kind, cast(count(*) as bigint) as hits from ({HITS_SQL}) group by kind")
def hits_by_kind(spark, sf_dir):
    return R.hits_by_kind(_hits(spark, sf_dir))


def _pairs(m) -> object:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query(f"select cast(file_ord as bigint) as file_ord, cast(sum(n) as bigint) as hits, string_agg(kind || '=' || n, ',' order by kind) as by_kind from (select file_ord, kind, count(*) as n from ({HITS_SQL}) group by all) group by file_ord")
def per_file_summary(spark, sf_dir):
    none = spark.createDataFrame([], "file_ord long, kind string, value string")
    out = R.per_file_summary(_hits(spark, sf_dir), none)
    return out.select("file_ord", "hits", _pairs(F.col("hits_by_kind")).alias("by_kind"))


@query(f"with h as (select file_ord, count(*) as hits from ({HITS_SQL}) group by file_ord) select 'f' || (97 - file_ord) as file, cast(hits as bigint) as hits, cast(row_number() over (order by hits desc, 'f' || (97 - file_ord)) as bigint) as place from h")
def per_file_order(spark, sf_dir):
    """The summary's rows in their order: most hits first, then by name."""
    from pyspark.sql import Window as W

    names = spark.range(50).select(F.col("id").alias("file_ord"), F.concat(F.lit("f"), (97 - F.col("id")).cast("string")).alias("rel_path"))
    out = R.per_file_summary(_hits(spark, sf_dir), spark.createDataFrame([], "file_ord long, kind string, value string"), names)
    placed = out.select("file", "hits", F.monotonically_increasing_id().alias("at"))  # follows the sorted partitions
    return placed.select("file", "hits", F.row_number().over(W.orderBy("at")).cast("long").alias("place"))


@query("select * from (values ('all off', 'off'), ('some skipped', 'skipped'), ('one ran', 'ok')) t(run, ner_status)")
def ner_status_fold(spark, sf_dir):
    """The recogniser's state of a run over all customers, from each one's."""
    one = F.col("c_custkey")
    runs = {"all off": F.lit("off"), "some skipped": F.when(one % 2 == 0, "skipped").otherwise("off"), "one ran": F.when(one == 1, "ok").otherwise("skipped")}
    folded = [R.ner_status(table(spark, sf_dir, "customer").select(s.alias("ner_status"))).select(F.lit(run).alias("run"), "ner_status") for run, s in runs.items()]
    return folded[0].unionAll(folded[1]).unionAll(folded[2])


@query(f"""
with c as (select '+31 6 ' || lpad(cast(c_custkey % 100 as varchar), 8, '1') as v from customer), m as (select 'u' || (c_custkey % 70) || '@corp.example' as v from customer)
select (select count(distinct v) from m)::bigint as residual_email, 0::bigint as residual_iban, (select count(distinct v) from c)::bigint as residual_phone, 0::bigint as residual_bsn, 0::bigint as residual_mac, 0::bigint as residual_postcode, 0::bigint as residual_dob,
(select count(distinct v) from m)::bigint as high_confidence, (select count(distinct v) from c)::bigint as warn""")
def residual_counts(spark, sf_dir):
    """Residuals of made-up text, distinct over the run, and their two levels."""
    text = F.expr("concat('tel +31 6 ', lpad(cast(c_custkey % 100 as string), 8, '1'), ' mail u', cast(c_custkey % 70 as string), '@corp.example')")
    rows = customers(spark, sf_dir, text).select(F.col("id").alias("file_ord"), F.explode(C.residuals(F.col("text"))).alias("r")).select("file_ord", "r.kind", "r.value")
    return R.residual_counts(rows).crossJoin(R.severity(rows))


#: Words as the engine cuts them: letters, marks, digits and joining punctuation of any script.
WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+')"


@query(f"""
with h as ({HITS_SQL}), n as (select * from h where kind in ('name', 'org', 'username')),
l as (select sum(len(list_filter({WORDS_SQL}, lambda w: lower(w) = 'the'))) as n from documents)
select (select count(*) from n where original = 'test')::bigint as stopword_name_hits, (select count(*) from n where original = 'Sam')::bigint as short_name_hits, coalesce((select n from l), 0)::bigint as stopword_loss,
((select count(*) from n where original in ('test', 'Sam')) + coalesce((select n from l), 0))::bigint as total""")
def prose_damage(spark, sf_dir):
    """A run that rewrote every 'the' of all documents, whatever their letters."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("text").alias("original"), F.regexp_replace("text", C.rx(r"\bthe\b", "i"), "PERSON_001").alias("text"))
    return R.prose_damage(_hits(spark, sf_dir), docs)


@query("select cast(4 as bigint) as map_poison_keys")
def map_poison(spark, sf_dir):
    keys = ["Sam Jansen", "Sam", "user", "PERSON_001", "or", "Jansen"]
    return A.poison_count(spark.createDataFrame([("person", k, "PERSON_001", 1, -1, 0, i) for i, k in enumerate(keys)] + [("email", "a@b", "x", 1, -1, 0, 9)], A.MAP_SCHEMA))


@query(f"with h as ({HITS_SQL}) select distinct lower(replacement) as key from h where file_ord = 7")
def map_prune(spark, sf_dir):
    """The map of all orders' clerks, pruned by what one file used."""
    clerks = table(spark, sf_dir, "orders").select(_clerk().alias("clerk")).distinct()
    pii_map = clerks.select(F.lit("username").alias("kind"), F.lower("clerk").alias("key"), F.col("clerk").alias("token"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("file_ord"), F.lit(0).alias("pass"), F.lit(0).cast("long").alias("pos"))
    return A.prune(pii_map, _hits(spark, sf_dir).filter("file_ord = 7")).select("key")


# --- files and staging ---------------------------------------------------------------------------------------
TREE = ["inbox/raw/a.md", "inbox/raw/_b.TXT", "inbox/raw/.env", "inbox/raw/x.pdf", "inbox/raw/x.bin", "inbox/raw/.gitkeep", "inbox/raw/source-export/c.md", "inbox/raw/d/e.csv", "inbox/raw/a/b.md", "inbox/raw/a.b", "README", "src/stories/STORY-1/intake-clean/z.xml"]


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(TREE)], "id long, path string")


@query(f"""select cast(id as bigint) as id, case when regexp_matches(v, '(^|/)\\.gitkeep$') then 'placeholder' when regexp_matches(v, '(^|/)source[-_]export/') then 'export'
when regexp_matches(lower(v), '\\.(xlsx|xls|pdf)$') then 'binary' when regexp_matches(lower(v), '[^/]\\.(md|txt|xml|html|htm|json|js|eml|csv|tsv|log|yml|yaml)$') or not regexp_matches(v, '[^/]\\.[^./]+$') then 'keep' else 'other' end as decision from {_values(TREE)}""")
def scan_filter(spark, sf_dir):
    return files.scan_filter(_tree(spark)).select("id", "decision")


@query(f"select v as path, cast(row_number() over (order by string_split(v, '/')) as bigint) as n from {_values(TREE)}")
def component_order(spark, sf_dir):
    from pyspark.sql import Window as W

    return _tree(spark).select("path", F.row_number().over(W.orderBy(files.component_order(F.col("path")))).cast("long").alias("n"))


@query(f"select v as path, case when starts_with(v, 'inbox/raw/') then 'inbox/clean' || substr(v, 10) else 'inbox/clean/' || string_split(v, '/')[-1] end as dest from {_values(TREE)}")
def mirror_path(spark, sf_dir):
    return _tree(spark).select("path", files.mirror_path(F.col("path")).alias("dest"))


DENIED = [".env", ".env.local", "a/.env", ".local/pii-map.json", "keys/x.key", "a/b/pii-map.json.bak", "inbox/raw/a.md", "inbox/clean/.gitkeep", "src/stories/S/a.md", "docs/env.md"]


@query(f"select v as path, id <= 6 as denied, starts_with(v, 'src/stories/') as story from {_values(DENIED)}")
def denied_paths(spark, sf_dir):
    df = spark.createDataFrame([(p,) for p in DENIED], "path string")
    return df.select("path", commit_gate.denied(F.col("path")).alias("denied"), commit_gate.is_story(F.col("path")).alias("story"))


STAGED = ["src/stories/S/a.md", "src/stories/S/a.bin", "src/stories/S/b", "src/stories/S/x.PDF", "src/stories/S/source-export/a.md", "src/stories/S/t.docx", "docs/a.md", "src/stories/S/sheet.xlsx"]


@query(f"select v as path, starts_with(v, 'src/stories/') and not regexp_matches(v, '/source[-_]export/') and not regexp_matches(lower(v), '\\.(xlsx|xls|pdf)$') as scanned from {_values(STAGED)}")
def gate_scanned(spark, sf_dir):
    """Which staged paths the commit gate reads."""
    df = spark.createDataFrame([(p,) for p in STAGED], "path string")
    return df.select("path", commit_gate.scanned(F.col("path")).alias("scanned"))


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    staged = parts.select(F.concat(F.lit("inbox/clean/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("rel_path"), F.sha2("p_name", 256).alias("sha256"), "p_partkey")
    manifest = staged.filter("p_partkey % 3 <> 0").withColumn("sha256", F.when(F.col("p_partkey") % 5 == 0, "stale").otherwise(F.col("sha256")))
    return staged, manifest


@query("select 'inbox/clean/' || p_partkey || '.md' as rel_path from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0")
def promote_select(spark, sf_dir):
    staged, manifest = _staged(spark, sf_dir)
    return staging.verified(staged, manifest).select("rel_path")


@query("select 'inbox/clean/' || p_partkey || '.md' as rel_path from part where p_partkey % 3 = 0")
def staging_prune(spark, sf_dir):
    staged, manifest = _staged(spark, sf_dir)
    return staging.to_prune(staged, manifest).select("rel_path")


@query("select 'inbox/clean/' || p_partkey || '.md' as rel_path, case when p_partkey % 7 = 0 then 'new' when p_partkey % 5 = 0 then 'stale' else sha256(p_name) end as sha256 from part where p_partkey % 3 <> 0 or p_partkey % 7 = 0")
def manifest_upsert(spark, sf_dir):
    staged, manifest = _staged(spark, sf_dir)
    written = staged.filter("p_partkey % 7 = 0").withColumn("sha256", F.lit("new"))
    return staging.upsert(manifest.select("rel_path", "sha256"), written).select("rel_path", "sha256")


@query("select 'inbox/clean/' || p_partkey || '.md' as rel_path, sha256(p_name) as sha256 from part where p_partkey % 2 = 0 and p_partkey % 3 = 0 union all select 'docs/' || p_partkey || '.md', sha256(p_name) from part where p_partkey % 2 = 1")
def manifest_retain(spark, sf_dir):
    """Staging keys stay only where the run wrote them."""
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "inbox/clean/").otherwise("docs/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    manifest = table(spark, sf_dir, "part").select(path.alias("rel_path"), F.sha2("p_name", 256).alias("sha256"), "p_partkey")
    return staging.retain(manifest.select("rel_path", "sha256"), manifest.filter("p_partkey % 3 = 0"))


@query("select p_partkey, p_partkey % 7 in (0, 1, 2) as output from part")
def intake_output(spark, sf_dir):
    """Which paths lie where the engine writes, placeholders aside."""
    folders = ["inbox/clean/", "Inbox/Clean/", "src/stories/S/intake-clean/", "inbox/raw/", "docs/", "inbox/cleaner/", "inbox/clean/.gitkeep"]
    folder = F.element_at(F.array(*[F.lit(f) for f in folders]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 7 == 6, folder).otherwise(F.concat(folder, F.col("p_partkey").cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "part").select("p_partkey", staging.is_intake_output(path).alias("output"))


@query("select * from (values ('STORY-12', 'src/stories/STORY-12/intake-clean'), ('stry7', 'src/stories/stry7/intake-clean'), ('x', null)) t(spec, target)")
def story_target(spark, sf_dir):
    df = spark.createDataFrame([("STORY-12",), ("stry7",), ("x",)], "spec string")
    return df.select("spec", staging.story_target(F.col("spec")).alias("target"))


@query("select cast(id as bigint) as id, case id when 0 then 'a' || chr(10) || 'b' || chr(10) || 'c' when 1 then 'ok' || chr(65533) else 'é' end as text from (values (0), (1), (2)) t(id)")
def decode_text(spark, sf_dir):
    rows = [(0, bytearray(b"a\r\nb\rc")), (1, bytearray(b"ok\xff")), (2, bytearray("é".encode()))]
    return spark.createDataFrame(rows, "id long, content binary").select("id", files.decode(F.col("content")).alias("text"))


# --- the engine on made-up documents ---------------------------------------------------------------------------
def scrubbed(name: str, text: str, want: str, customer_text: str | None = None, customer_want: str | None = None, **switches) -> None:
    """Register the whole engine over a document per nation, and over one per customer.

    ``want`` is its text in DuckDB; ``customer_text`` and ``customer_want`` stand in where
    nations' values don't reach.
    """

    def run(spark, sf_dir):
        from ..operators.scrub import scrub

        docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_ord"), F.expr(text).alias("text"))
        return scrub(docs, None, Options(allowlist=frozenset(ALLOW), **switches)).documents.select("file_ord", "text")

    run.__name__ = name
    query(f"select cast(n_nationkey as bigint) as file_ord, {want} as text from nation")(run)

    def run_customers(spark, sf_dir):
        from ..operators.scrub import scrub

        docs = customers(spark, sf_dir, F.expr(customer_text or of_customers(text)), "file_ord")
        return scrub(docs, None, Options(allowlist=frozenset(ALLOW), **switches)).documents.select("file_ord", "text")

    run_customers.__name__ = f"{name}_customers"
    query(f"select cast(c_custkey as bigint) as file_ord, {customer_want or of_customers(want)} as text from (select c_custkey, row_number() over (order by c_custkey) as n from customer)")(run_customers)


# a group of an IPv6 address has four digits, a house number five and a MAC octet two: the texts below keep to that for any key
NUMBER = "printf('%03d', n_nationkey + 1)"
TECHNICAL = (
    "concat('host: srv', cast(c_custkey as string), '\nsee /tmp/f', cast(c_custkey as string), ' of 10.', cast(cast(floor(c_custkey / 65536) % 256 as int) as string), '.', cast(cast(floor(c_custkey / 256) % 256 as int) as string), '.', cast(c_custkey % 256 as string), '\ngit log ', cast(c_custkey as string))",
    "concat('host: MACHINE_', printf('%03d', n), '\nsee PATH_', printf('%03d', n), ' of 203.0.113.', cast(n % 254 + 1 as string), '\nCMD_', printf('%03d', n))",
)
VALUES = (
    f"concat('mac 0', substr({K9}, 1, 1), ':', substr({K9}, 2, 2), ':44:', substr({K9}, 4, 2), ':', substr({K9}, 6, 2), ':', substr({K9}, 8, 2), ' tel +31 6 ', substr({K9}, 2, 8), ' dob: 2001-02-03')",
    "concat('mac 00:00:5e:00:53:', printf('%02x', n), ' tel PHONE_', printf('%03d', n), ' dob: 1900-01-02')",
)
scrubbed("name_scrub", f"concat('| Reporter | ', {PERSON}, ' |\nthen ', lower({PERSON}), ' called ', {PERSON})", f"concat('| Reporter | PERSON_', {NUMBER}, ' |\nthen PERSON_', {NUMBER}, ' called PERSON_', {NUMBER})", expand_name_parts=False)
scrubbed("org_scrub", "concat('Esprit and DUSTIN of ', cast(n_nationkey as string))", "concat('ORG_001 and ORG_002 of ', cast(n_nationkey as string))", orgs=("Esprit", "Dustin", "Absent"))
scrubbed("org_longest_scrub", "concat('Esprit Holding and Esprit of ', cast(n_nationkey as string))", "concat('ORG_002 and ORG_001 of ', cast(n_nationkey as string))", orgs=("Esprit", "Esprit Holding"))
scrubbed("username_scrub", "concat('<sys_created_by>User', cast(n_nationkey as string), '</sys_created_by> by user', cast(n_nationkey as string))", f"concat('<sys_created_by>username_', {NUMBER}, '</sys_created_by> by username_', {NUMBER})")
scrubbed("login_scrub", "concat('<sysevent><name>login</name><parm1>usr', cast(n_nationkey as string), '</parm1><parm2>10.0.0.1</parm2></sysevent>')", f"concat('<sysevent><name>login</name><parm1>username_', {NUMBER}, '</parm1><parm2>10.0.0.1</parm2></sysevent>')")
scrubbed("name_address_scrub", f"concat('From: ', {PERSON}, ' <u', cast(n_nationkey as string), '@corp.example>, noreply@example.org')", f"concat('From: PERSON_', {NUMBER}, ' <user_', {NUMBER}, '@example.test>, noreply@example.org')")
scrubbed("csv_scrub", f"concat('naam,email\n', {PERSON}, ',u', cast(n_nationkey as string), '@corp.example\n')", f"concat('naam,email\nPERSON_', {NUMBER}, ',user_', {NUMBER}, '@example.test\n')", expand_name_parts=False)
scrubbed("technical_scrub", "concat('host: srv', cast(n_nationkey as string), '\nsee /tmp/f', cast(n_nationkey as string), ' of 10.1.2.', cast(n_nationkey as string), '\ngit log ', cast(n_nationkey as string))", f"concat('host: MACHINE_', {NUMBER}, '\nsee PATH_', {NUMBER}, ' of 203.0.113.', cast(n_nationkey + 2 as string), '\nCMD_', {NUMBER})", *TECHNICAL, ip=True, machines=True, paths=True, commands=True)
scrubbed("value_scrub", "concat('mac 00:1B:44:11:3A:', lpad(cast(n_nationkey as string), 2, '0'), ' tel +31 6 123456', lpad(cast(n_nationkey as string), 2, '0'), ' dob: 2001-02-03')", f"concat('mac 00:00:5e:00:53:', printf('%02x', n_nationkey + 1), ' tel PHONE_', {NUMBER}, ' dob: 1900-01-02')", *VALUES)

#: A valid account number of a customer or nation, written as bytes that both checks know.
K10 = "lpad(cast(n_nationkey as string), 10, '0')"
ACCOUNT = f"concat('NL', lpad(cast(98 - cast(concat('10112310', {K10}, '232100') as decimal(38,0)) % 97 as string), 2, '0'), 'ABNA', {K10})"
scrubbed("json_user_scrub", "concat('{{\"sys_updated_by\": \"User', cast(n_nationkey as string), '\"}} by user', cast(n_nationkey as string))".replace("{{", "{").replace("}}", "}"), f"concat('{{\"sys_updated_by\": \"username_', {NUMBER}, '\"}} by username_', {NUMBER})")
scrubbed("ipv6_scrub", "concat('at fe80::', lower(hex(n_nationkey + 1)), ' and ::1 or 2001:db8::5 end')", "concat('at 2001:db8::', printf('%x', n_nationkey + 1), ' and ::1 or 2001:db8::5 end')", "concat('at fe80:', case when c_custkey < 65536 then '' else concat(lower(hex(c_custkey div 65536)), ':') end, ':', lower(hex(c_custkey % 65536)), ' and ::1 or 2001:db8::5 end')", "concat('at 2001:db8::', printf('%x', n), ' and ::1 or 2001:db8::5 end')", ip=True)
scrubbed("iban_scrub", f"concat('pay ', {ACCOUNT}, ' now')", f"concat('pay IBAN_', {NUMBER}, ' now')")
scrubbed("cert_scrub", "concat('a\n-----BEGIN KEY-----\nk', cast(n_nationkey as string), '\n-----END KEY-----\nb')", f"concat('a\nCERT_', {NUMBER}, 'b')", certificates=True)
scrubbed("postcode_scrub", "concat('Kerkstraat ', cast(n_nationkey + 1 as string), ', 1234 AB end')", f"concat('9999 XX', printf('%02d', n_nationkey + 1), ' end')", "concat('Kerkstraat ', cast(c_custkey % 100000 as string), ', ', cast(1234 + c_custkey div 100000 as string), ' AB end')", "concat('9999 XX', printf('%02d', n), ' end')")
scrubbed("bsn_scrub", "concat('bsn: 111222333 of ', cast(n_nationkey as string))", "concat('bsn: 000000001 of ', cast(n_nationkey as string))", nl_id=True)


def dictionary_paths(name: str, broadcast_entries: int) -> None:
    """The dictionary over accented, decomposed and odd-cased names, by either way to the documents."""

    def run(spark, sf_dir):
        from ..operators.scrub import scrub

        text = "concat('<sys_created_by>jos\u00e9', cast(c_custkey as string), '</sys_created_by> JOS\u00c9', cast(c_custkey as string), ', ka\u017fper and KASPER, \u212aasper, jose\u0301, jose; <sys_updated_by>kasper</sys_updated_by> <sys_updated_by>jose</sys_updated_by>')"
        docs = customers(spark, sf_dir, F.expr(text), "file_ord")
        return scrub(docs, None, Options(broadcast_entries=broadcast_entries, harvest_names=False)).documents.select("file_ord", "text")

    run.__name__ = name
    first = "case when n = 1 then 1 else n + 2 end"
    want = f"""concat('<sys_created_by>username_', printf('%03d', {first}), '</sys_created_by> username_', printf('%03d', {first}), ', username_002 and username_002, username_002, username_003\u0301, username_003; <sys_updated_by>username_002</sys_updated_by> <sys_updated_by>username_003</sys_updated_by>')"""
    query(f"select cast(c_custkey as bigint) as file_ord, {want} as text from (select c_custkey, row_number() over (order by c_custkey) as n from customer)")(run)


dictionary_paths("dictionary_broadcast", 1_000_000)
dictionary_paths("dictionary_joined", 0)


@query()
def irreversible_scrub(spark, sf_dir):
    """Keyed digests in place of numbers; no map is kept."""
    from ..operators.scrub import scrub

    docs = customers(spark, sf_dir, F.expr("concat('u', cast(c_custkey as string), '@corp.example')"), "file_ord")
    return scrub(docs, None, Options(irreversible=True, secret=b"bench")).documents.select("file_ord", "text")


@query()
def find_pii_table_function(spark, sf_dir):
    """The table function over the documents: kinds, values and places."""
    from ..functions.register import FindPii

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.lateralJoin(FindPii(F.col("text").outer())).select("doc_id", "kind", "value", "start", "end")


@query("select doc_id, contains(text, '-----BEGIN ') or regexp_matches(text, '(?im)^(?:[\\$>]+\\s*)?(?:py(?:thon)?(?:\\s+-3)?|powershell|pwsh|Get-Content|curl|git|npm|node|bash|sh)\\b') or regexp_matches(text, '(?i)\\b(?:hostname|host|machine(?:-|\\s)?name|computer(?:\\s+name)?)\\s*[:=]\\s*\\S') or regexp_matches(text, '(^|[^@\\w:])/(?:home|Users|tmp|opt|var|mnt)/[^\\s\"''<>|\\r\\n]+') or regexp_matches(text, '(^|[^@\\w])[A-Za-z]:\\\\[^\\s\"''<>|\\r\\n]+') as technical from documents where text is not null")
def technical_risk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", C.looks_technical(F.col("text")).alias("technical"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
