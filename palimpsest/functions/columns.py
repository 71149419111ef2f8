"""Column functions: predicates, checksums and detectors inside Spark's own engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes, as Python reads it; ``$`` before a line feed only."""
    return f"(?dUu{flags})" + pattern


def ustrip(value: Column) -> Column:
    """Without white space at either end, Unicode's too."""
    return F.regexp_replace(value, rx(r"^\s+|\s+$"), "")


def find_all(text: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group)), F.array().cast("array<string>"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def first_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """Values whose key has not come before, order kept."""

    def first(vs: Column, keys: Column) -> Column:
        return F.filter(vs, lambda v, i: F.array_position(keys, keys[i]) == i + 1)

    return bound(values, lambda vs: bound(F.transform(vs, key), lambda keys: first(vs, keys)))


# --- predicates ---------------------------------------------------------------------------
def is_token(value: Column) -> Column:
    return F.coalesce(ustrip(value).rlike(rx("^" + X.PSEUDO_TOKEN + r"\z", "i")), F.lit(False))


def allowlisted(value: Column, allow: list[str]) -> Column:
    return F.lower(value).isin([a.lower() for a in allow]) if allow else F.lit(False)


def iban_ok(value: Column) -> Column:
    """The mod-97 check, spaces and dashes aside."""
    compact = F.upper(F.regexp_replace(value, rx(r"[\s\-]"), ""))
    turned = F.concat(F.substring(compact, 5, 100), F.substring(compact, 1, 4))

    def step(rest: Column, ch: Column) -> Column:
        letter = ch.between("A", "Z")
        worth = F.when(letter, F.ascii(ch) - 55).otherwise(F.ascii(ch) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + worth) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, ch: F.when(ch == "", r).otherwise(step(r, ch)))
    return F.coalesce(compact.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def bsn_ok(value: Column) -> Column:
    """The 11-test of eight or nine digits."""
    digits = F.lpad(F.trim(value), 9, "0")
    weights = F.array(*[F.lit(w) for w in (9, 8, 7, 6, 5, 4, 3, 2, -1)])
    products = F.transform(weights, lambda w, i: w * F.ascii(F.substr(digits, i + 1, F.lit(1))) - w * 48)
    total = F.aggregate(products, F.lit(0), lambda a, b: a + b)
    return F.coalesce(F.trim(value).rlike("^[0-9]{8,9}$") & (digits != "000000000") & (total % 11 == 0), F.lit(False))


def looks_like_name(value: Column, single: bool = False) -> Column:
    """The person-name predicate on values without markup."""
    plain = F.regexp_replace(F.regexp_replace(value, rx(r"\s+"), " "), r"^[ \t.:;,\-]+|[ \t.:;,\-]+$", "")
    least = 1 if single else 2

    def proper(w: Column) -> Column:
        return w.rlike("^[A-ZÀ-Ý]") & ~w.rlike(rx(r"\d")) & ~((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 5))

    def words_fine(words: Column) -> Column:
        own = F.filter(words, lambda w: ~F.lower(w).isin(X.PARTICLES))
        return F.size(words).between(least, 5) & F.forall(words, lambda w: w != "") & bound(own, lambda p: F.forall(p, proper) & (F.size(p) >= least))

    def fine(name: Column) -> Column:
        words = F.transform(F.split(name, " "), lambda w: F.regexp_replace(w, r"""^[.,;:'"()]+|[.,;:'"()]+$""", ""))
        return (
            F.length(name).between(3 if single else 4, 80)
            & bound(words, words_fine)
            & ~is_token(name)
            & ~F.lower(name).isin(X.DENY)
            & ~F.replace(name, F.lit(" "), F.lit("")).rlike("(?i)^" + X.TICKET + "$")
            & ~name.rlike("(?i)^" + X.SYS_ID + "$")
            & ~name.rlike(r"(?i)https?://|www\.")
        )

    return F.coalesce(bound(plain, fine), F.lit(False))


def is_scrubbed(value: Column) -> Column:
    return F.upper(value).rlike("^(" + "|".join(X.SCRUBBED_PREFIXES) + ")")


def looks_technical(text: Column) -> Column:
    """A paste that holds key material, commands, labelled hosts or absolute paths."""
    found = text.contains("-----BEGIN ") | text.rlike(rx(X.COMMAND, "im")) | text.rlike(rx(X.MACHINE_LABEL + r"\S", "i"))
    return F.coalesce(found | text.rlike(rx(X.PATH_WINDOWS)) | text.rlike(rx(X.PATH_UNIX)), F.lit(False))


# --- detectors: arrays in order of appearance ------------------------------------------------
def emails(text: Column) -> Column:
    # without a sign the pattern would be tried at every place
    return F.when(text.contains("@"), find_all(text, X.EMAIL, flags="i")).otherwise(F.array().cast("array<string>"))


def residual_emails(text: Column, allow: list[str] | None = None) -> Column:
    return F.filter(emails(text), lambda v: ~F.lower(v).endswith("@example.test") & ~allowlisted(v, allow or []))


def named_addresses(text: Column) -> Column:
    """Structs of display name and address."""
    both = F.arrays_zip(find_all(text, X.NAME_ANGLE, 1, "i").alias("display"), find_all(text, X.NAME_ANGLE, 2, "i").alias("email"))
    return F.transform(both, lambda p: F.struct(F.trim(p["display"]).alias("display"), p["email"].alias("email")))


def audit_users_xml(text: Column) -> Column:
    return find_all(text, X.AUDIT_XML, 2, "i")


def audit_users_json(text: Column) -> Column:
    return find_all(text, X.AUDIT_JSON, 2, "i")


def phones(text: Column) -> Column:
    return find_all(text, X.PHONE)


def ibans(text: Column) -> Column:
    return F.filter(find_all(text, X.IBAN, 1, "i"), iban_ok)


def bsns(text: Column, bare: bool = False) -> Column:
    found = find_all(text, X.BSN_LABELLED, 1, "i")
    if bare:
        found = F.concat(found, find_all(text, X.BSN_BARE, 1))
    return F.array_distinct(F.filter(found, bsn_ok))


def macs(text: Column) -> Column:
    return find_all(text, X.MAC)


def street_postcodes(text: Column) -> Column:
    return first_by(find_all(text, X.POSTCODE_STREET, 0, "i"), F.lower)


def bare_postcodes(text: Column) -> Column:
    return find_all(text, X.POSTCODE_BARE, 1)


def dobs(text: Column) -> Column:
    return find_all(text, X.DOB, 1, "i")


def ipv4s(text: Column) -> Column:
    """Addresses that are replaced: not loopback, unspecified or reserved; leading zeros are no address."""
    return F.filter(find_all(text, X.IPV4), lambda v: ~v.rlike(r"^(127\.|0\.0\.0\.0$|203\.0\.113\.)") & ~v.rlike(r"(^|\.)0[0-9]"))


def machines(text: Column) -> Column:
    return F.array_distinct(F.filter(find_all(text, X.MACHINE, 2, "i"), lambda v: ~is_scrubbed(v)))


def paths(text: Column) -> Column:
    both = F.concat(find_all(text, X.PATH_WINDOWS, 1), find_all(text, X.PATH_UNIX, 1))
    return F.array_distinct(F.filter(both, lambda v: ~is_scrubbed(v)))


def commands(text: Column) -> Column:
    found = F.transform(find_all(text, X.COMMAND, 0, "im"), ustrip)
    return F.array_distinct(F.filter(found, lambda v: (v != "") & ~is_scrubbed(v)))


def pems(text: Column) -> Column:
    whole = r"^" + X.PEM_BEGIN + r"\r?\n(?:.*?\r?\n)??" + X.PEM_END + r"(?:\r?\n|\z)"
    return F.array_distinct(F.filter(find_all(text, whole, 0, "ms"), lambda v: F.length(v) <= X.PEM_MOST_CHARS))


DETECTORS: dict[str, Callable[[Column], Column]] = {
    "email": emails, "iban": ibans, "phone": phones, "bsn": bsns, "mac": macs, "postcode": street_postcodes, "dob": dobs,
    "ip": ipv4s, "machine": machines, "path": paths, "cmd": commands, "cert": pems,
}


def residuals(text: Column, allow: list[str] | None = None, nl_id: bool = False, p2: bool = True) -> Column:
    """Array of (kind, value) that a scrubbed text still holds."""
    kinds = {"email": residual_emails(text, allow), "iban": ibans(text), "phone": phones(text)}
    if nl_id:
        kinds["bsn"] = bsns(text)
    if p2:
        kinds |= {"mac": macs(text), "postcode": F.concat(street_postcodes(text), bare_postcodes(text)), "dob": dobs(text)}
    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    return F.concat(*[tagged(k, v) for k, v in kinds.items()])


# --- harvesting from labelled fields, for text without markup ---------------------------------
def split_names(blob: Column, single: bool = False) -> Column:
    """Names in lines, bullets and lists, spellings that differ by case once."""
    lines = F.transform(F.split(blob, r"\n"), lambda x: ustrip(F.regexp_replace(ustrip(x), rx(r"^[-*•]+\s*"), "")))
    pieces = F.flatten(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.split(x, rx(X.LIST_SPLIT, "i"))))
    names = F.transform(pieces, lambda p: F.regexp_replace(ustrip(p), r"^[.:;]+|[.:;]+$", ""))
    return first_by(F.filter(names, lambda n: looks_like_name(n, single)), F.lower)


def is_person_label(label: Column, labels: list[str] | None = None) -> Column:
    words = "|".join(x.replace(" ", r"\s+") for x in labels or X.LABELS)
    return label.rlike(rx(rf"^\s*(?:{words})(?:\s*\([^)]*\))?\s*:?\s*\z", "is"))


def harvest_table(text: Column, single: bool = False) -> Column:
    rows = F.transform(find_all(text, X.TABLE_ROW, 1, "m"), lambda r: F.transform(F.split(r, r"\|"), ustrip))
    rows = F.filter(rows, lambda r: (F.size(r) > 1) & is_person_label(r[0]))
    return F.flatten(F.transform(rows, lambda r: split_names(F.array_join(F.slice(r, 2, F.size(r) - 1), "|"), single)))


def harvest_bullets(text: Column, single: bool = False) -> Column:
    both = F.arrays_zip(find_all(text, X.HEADING_BULLETS, 1, "im").alias("label"), find_all(text, X.HEADING_BULLETS, 2, "im").alias("body"))
    both = F.filter(both, lambda p: is_person_label(p["label"]))
    return F.flatten(F.transform(both, lambda p: split_names(p["body"], single)))


def harvest_test_with(text: Column, single: bool = False) -> Column:
    return F.flatten(F.transform(find_all(text, X.TEST_WITH, 1, "i"), lambda b: split_names(b, single)))


def harvest_xml(text: Column, single: bool = False) -> Column:
    pattern = rf"<(?:{'|'.join(X.XML_TAGS)})\b[^>]*\bdisplay_value=(['\"])(.*?)\1"
    return F.flatten(F.transform(find_all(text, pattern, 2, "is"), lambda b: split_names(b, single)))


def harvest_json(text: Column, single: bool = False) -> Column:
    pattern = rf'"(?:{"|".join(X.JSON_KEYS)})"\s*:\s*\{{[^{{}}]*?"display_value"\s*:\s*"([^"]+)"'
    return F.flatten(F.transform(find_all(text, pattern, 1, "is"), lambda b: split_names(b, single)))


def name_parts(name: Column) -> Column:
    """The words of a full name that may stand for it alone."""
    words = F.transform(F.split(ustrip(name), rx(r"\s+")), lambda w: F.regexp_replace(w, r"""^[.,;:'"()]+|[.,;:'"()]+$""", ""))
    fine = F.filter(
        words,
        lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(X.PARTICLES + X.DENY) & ~((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 5))
        & ~w.rlike(rx(r"\d")) & w.rlike("^[A-Za-zÀ-ÿ]"),
    )
    return F.when(F.size(words) > 1, fine).otherwise(F.array().cast("array<string>"))
