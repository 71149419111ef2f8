"""The rewriting passes over one text, in their fixed order.

A pass asks ``give(pass_no, kind, value)`` for each value's token and tells ``log(pass_no,
kind, original, replacement)`` about each replacement. The same passes serve to find values
(``give`` notes them and answers with a stand-in of the token's shape) and to rewrite
(``give`` looks tokens up).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa

from . import textops as t

_WORD = re.compile(r"\w+")

Give = Callable[[int, str, str], str]
Log = Callable[[int, str, str, str], None]

#: Pass numbers; harvested names, recognised names and organisations only grow the map.
NAME_ADDRESS, ADDRESS, XML_USER, JSON_USER, LOGIN, HARVEST, RECOGNISED, ORGS = 1, 2, 3, 4, 5, 6, 7, 8
NAMES, ORG_NAMES, USERS = 9, 10, 11
VALUE_PASSES = {"ip": 12, "cert": 13, "path": 14, "cmd": 15, "machine": 16, "iban": 17, "phone": 18, "bsn": 19, "mac": 20, "postcode": 21, "dob": 22}
#: What a stand-in looks like while numbers are not known yet.
STAND_IN = {
    "email": "user_000@example.test", "username": "username_000", "person": "PERSON_000", "org": "ORG_000", "ip": "203.0.113.1",
    "phone": "PHONE_000", "iban": "IBAN_000", "bsn": "000000000", "mac": "00:00:5e:00:53:00", "postcode": "9999 XX00", "dob": "1900-01-01",
    "machine": "MACHINE_000", "path": "PATH_000", "cmd": "CMD_000", "cert": "CERT_000",
}


def person_token(give: Give, no: int, name: str) -> str:
    """A name's token; tokens and ordinary words stay as they are and are never mapped."""
    if t.is_token(name):
        return name.strip()
    return name if name.strip().lower() in t.DENY else give(no, "person", name)


def address_passes(text: str, allow: frozenset[str], give: Give, log: Log) -> str:
    """Display names with an address, then bare addresses."""

    def named(m: re.Match) -> str:
        display, address = m[1].strip(), m[2]
        if address.lower() in allow:
            return m[0]
        token = address
        if not address.lower().endswith("@example.test"):
            token = give(NAME_ADDRESS, "email", address)
            log(NAME_ADDRESS, "email", address, token)
        if t.is_token(display):
            return f"{display} <{token}>"
        name = person_token(give, NAME_ADDRESS, display) if len(display) >= 4 else "PERSON_SHORT"
        log(NAME_ADDRESS, "name", display, name)
        return f"{name} <{token}>"

    def bare(m: re.Match) -> str:
        if m[0].lower() in allow or m[0].lower().endswith("@example.test"):
            return m[0]
        token = give(ADDRESS, "email", m[0])
        log(ADDRESS, "email", m[0], token)
        return token

    if "@" not in text:  # both patterns need one, and would try every place
        return text
    return t.EMAIL.sub(bare, t.NAME_ANGLE.sub(named, text) if "<" in text else text)


def account_passes(text: str, allow: frozenset[str], give: Give, log: Log) -> str:
    """Audit users in XML and JSON, then the parameters of login events."""

    def audit(no: int) -> Callable[[re.Match], str]:
        def one(m: re.Match) -> str:
            user = m[2]
            if user.lower() in allow or user.lower().startswith("username_"):
                return m[0]
            token = give(no, "username", user)
            log(no, "username", user, token)
            return m[1] + token + m[3]

        return one

    def parameter(m: re.Match) -> str:
        value = m[2].strip()
        found = t.login_value(value, allow)
        if found is None:
            return m[0]
        kind = found[0]
        token = person_token(give, LOGIN, value) if kind == "person" else give(LOGIN, kind, value)
        if token == value:
            return m[0]
        log(LOGIN, "name" if kind == "person" else kind, value, token)
        at = m.start(2) - m.start()
        return m[0][:at] + token + m[0][at + len(m[2]) :]

    def event(m: re.Match) -> str:
        name = t.SYSEVENT_NAME.search(m[1])
        if name is None or name[1].strip().lower() not in t.X.LOGIN_EVENTS:
            return m[0]
        at = m.start(1) - m.start()
        return m[0][:at] + t.SYSEVENT_PARM.sub(parameter, m[1]) + m[0][at + len(m[1]) :]

    low = text.lower()
    if "_created_by" in low or "_updated_by" in low:
        text = t.AUDIT_JSON.sub(audit(JSON_USER), t.AUDIT_XML.sub(audit(XML_USER), text))
    return t.SYSEVENT.sub(event, text) if "event" in low else text


#: Letters whose capitals are several, and that match each other.
_TWINS = {"\u1fd3": "\u0390", "\u1fe3": "\u03b0", "\ufb06": "\ufb05"}


@lru_cache(65_536)
def _fold_letter(letter: str) -> str:
    letter = _TWINS.get(letter, letter)
    upper = letter.upper()
    return (upper if len(upper) == 1 else letter).lower()[0]


def fold(word: str) -> str:
    """One form for all spellings of a word that case-insensitive matching takes as equal."""
    return word.lower() if word.isascii() else "".join(map(_fold_letter, word))


#: Words that a token may bring into a text; what is looked up are the words of the text before.
_TOKEN_WORD = re.compile(r"(?:person|org|username|user|uhmaskedaddr|redacted)_\w*|example|test")


def _unit(folded: str) -> int:
    return crc32(folded.encode("utf-8", "surrogatepass"))


def _pair(one, other):
    """The digest of a pair of words, from theirs; of integers or arrays of them."""
    return (one * 0x9E3779B1 + other) & 0xFFFFFFFF


def units_of_key(key: str) -> list[int]:
    """Digests, each of which a text has wherever the key occurs: of the key's pairs of words, else of its first word."""
    words = [*map(fold, _WORD.findall(key))]
    pairs = [_pair(_unit(a), _unit(b)) for a, b in pairwise(words) if not (_TOKEN_WORD.fullmatch(a) or _TOKEN_WORD.fullmatch(b))]
    return pairs or [_unit((words or [""])[0])]


def units_of(text: str) -> set[int]:
    """The digests of a text's folded words and pairs of words; that of no word is in all."""
    found = _WORD.findall(text)
    of = {w: _unit(fold(w)) for w in set(found)}
    units = [of[w] for w in found]
    if len(units) < 64:  # too few for arrays to be faster
        pairs = [_pair(a, b) for a, b in pairwise(units)]
    else:
        each = np.array(units, np.uint64)
        pairs = _pair(each[:-1], each[1:]).tolist()
    return {_unit(""), *of.values(), *pairs}


class Dictionary:
    """Dictionary entries (kind, key, token, file_ord) in their order, found by their rarest unit.

    Kept as columns: some 70 bytes an entry in each worker.
    """

    def __init__(self, entries: pa.Table) -> None:
        self.kind, self.key, self.token = (entries[c].combine_chunks() for c in ("kind", "key", "token"))
        self.file_ord = entries["file_ord"].to_numpy()
        units, ends = array("I"), array("Q", [0])
        for batch in entries.select(["key"]).to_batches(10_000):
            for key in batch["key"].to_pylist():
                units.extend(units_of_key(key))
                ends.append(len(units))
        flat = np.frombuffer(units, np.uint32)
        best = np.empty(0, np.uint32)
        if len(flat):
            _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
            ranked = (counts[at].astype(np.uint64) << np.uint64(32)) | flat
            best = np.minimum.reduceat(ranked, np.frombuffer(ends, np.uint64)[:-1].astype(np.int64)).astype(np.uint32)
        self.order = np.argsort(best, kind="stable").astype(np.int32)
        self.units = best[self.order]

    def near(self, text: str, upto: int | None = None) -> list[tuple[str, str, str]]:
        """The entries that may occur in a text, of those first seen in documents up to ``upto``."""
        if not len(self.units):
            return []
        wanted = np.fromiter(units_of(text), np.uint32)
        low, high = (np.searchsorted(self.units, wanted, side) for side in ("left", "right"))
        some = np.flatnonzero(low < high)
        found = sorted(n for i in some for n in self.order[low[i] : high[i]].tolist() if upto is None or self.file_ord[n] <= upto)
        return [(self.kind[n].as_py(), self.key[n].as_py(), self.token[n].as_py()) for n in found]


@lru_cache(8)
def _folded(text: str) -> str:
    """A text with each letter folded; of the same length."""
    if not text.isascii():
        for letter in set(text):
            if letter > "\x7f" and (to := _fold_letter(letter)) != letter:
                text = text.replace(letter, to)
    return text.lower()  # folded letters are their own


@lru_cache(65_536)
def _alike(one: str, other: str) -> bool:
    """Whether case-insensitive matching takes two letters as equal."""
    return re.fullmatch(re.escape(one), other, re.IGNORECASE) is not None


def _each_match(text: str, key: str, words: bool, one: Callable[[str, str, int, int], str]) -> str:
    """Each occurrence of a key, whatever its case, through ``one(whole, text, start, end)``; with ``words``, whole words only.

    The same as the pattern, which takes longer to compile than a text to search: letters are
    found by their fold, which covers all that match, and compared by the pattern's own rule.
    """
    low, folded, size = _folded(text), _folded(key), len(key)
    plain = text.isascii() and key.isascii()
    out, done, at = [], 0, low.find(folded)
    while at >= 0:
        end = at + size
        edge = words and (_is_word(text[at - 1 : at] if at else "") == _is_word(text[at]) or _is_word(text[end - 1]) == _is_word(text[end : end + 1]))
        if edge or not (plain or text[at:end] == key or all(a == b or _alike(a, b) for a, b in zip(key, text[at:end], strict=True))):
            at = low.find(folded, at + 1)
            continue
        out += [text[done:at], one(text[at:end], text, at, end)]
        done, at = end, low.find(folded, end)
    return "".join(out) + text[done:] if done else text


def _is_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def dictionary_passes(text: str, entries: list[tuple[str, str, str]], allow: frozenset[str], log: Log) -> str:
    """Mapped names, organisations and user names as whole words, longest first.

    ``entries``: (kind, key, token) in the order in which they were first seen.
    """
    if not entries:
        return text
    low = text.lower()

    def rewrite(text: str, no: int, kind: str, log_kind: str) -> str:
        own = sorted((e for e in entries if e[0] == kind), key=lambda e: -len(e[1]))
        for _, key, token in own:
            if kind == "person" and (len(key) < 3 or key == token or t.is_token(key) or key.lower() in t.DENY):
                continue
            if kind == "org" and (len(key) < 3 or key == token or key.lower() in allow):
                continue
            if key.isascii() and key.lower() not in low and text.isascii():
                continue

            def one(whole: str, text: str, start: int, end: int, token: str = token) -> str:
                if kind == "person" and t.is_token(whole) or kind == "username" and whole.lower().startswith("username_"):
                    return whole
                if t.inside_email(text, start, end):
                    return whole
                log(no, log_kind, whole, token)
                return token

            text = _each_match(text, key, True, one)
        return text

    for no, kind, log_kind in ((NAMES, "person", "name"), (ORG_NAMES, "org", "org"), (USERS, "username", "username")):
        text = rewrite(text, no, kind, log_kind)
        low = text.lower()
    return text


_FIND = {
    "cert": t.find_pems, "path": t.find_paths, "cmd": t.find_commands, "iban": t.find_ibans, "phone": t.find_phones, "bsn": t.find_bsns,
    "mac": t.find_macs, "postcode": t.find_street_postcodes, "dob": t.find_dobs,
}
_FOLDED = {"iban", "mac", "postcode"}
_OWN = {"phone": "phone_", "mac": "00:00:5e:00:53:", "postcode": "9999", "dob": "1900-01-"}


def value_pass(text: str, kind: str, allow: frozenset[str], give: Give, log: Log) -> str:
    """One pass of a kind whose values are found by their form."""
    no = VALUE_PASSES[kind]
    if kind == "ip":

        def address(m: re.Match) -> str:
            if not t.ip_token_wanted(m[0]):
                return m[0]
            token = give(no, "ip", m[0])
            log(no, "ip", m[0], token)
            return token

        text = t.IPV4.sub(address, text) if t.may_hold_ipv4(text) else text
        return t.IPV6.sub(address, text) if t.may_hold_ipv6(text) else text
    if kind == "machine":

        def machine(m: re.Match) -> str:
            if t.is_token(m[2]) or m[2].upper().startswith("MACHINE_"):
                return m[0]
            token = give(no, "machine", m[2])
            log(no, "machine", m[2], token)
            return m[1] + token

        return t.MACHINE.sub(machine, text) if t.may_hold_machine(text) else text
    # the longest first; equal lengths by first appearance, so that numbering is determined
    for value in sorted(dict.fromkeys(_FIND[kind](text)), key=len, reverse=True):
        if kind in _OWN and value.lower().startswith(_OWN[kind]) or kind == "phone" and value.lower() in allow:
            continue
        token = give(no, kind, value)

        def one(*_: object, value: str = value, token: str = token) -> str:
            log(no, kind, value, token)
            return token

        if kind == "bsn":
            text = re.sub(rf"\b{re.escape(value)}\b", one, text)
        elif kind in _FOLDED:
            text = _each_match(text, value, False, one)
        else:
            for _ in range(text.count(value)):
                one()
            text = text.replace(value, token)
    return text
