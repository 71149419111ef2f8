"""What a run does, and which combinations are refused."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..functions import fixed as X


@dataclass(frozen=True)
class PersonFields:
    """The labelled fields that names are harvested from."""

    xml_tags: tuple[str, ...] = tuple(X.XML_TAGS)
    json_keys: tuple[str, ...] = tuple(X.JSON_KEYS)
    csv_headers: tuple[str, ...] = tuple(X.CSV_HEADERS)
    labels: tuple[str, ...] = tuple(X.LABELS)

    @classmethod
    def load(cls, path: str | Path | None) -> PersonFields:
        """From JSON; what is missing or unreadable keeps its default."""
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
        except (OSError, ValueError):
            data = {}
        data = data if isinstance(data, dict) else {}
        names = {"xml_tags": "xml_display_tags", "json_keys": "json_display_keys", "csv_headers": "csv_person_headers", "labels": "person_field_labels"}
        given = {ours: tuple(str(v).lower() if ours == "csv_headers" else str(v) for v in data[theirs]) for ours, theirs in names.items() if isinstance(data.get(theirs), list) and data[theirs]}
        return cls(**given)


@dataclass(frozen=True)
class Options:
    """Detection switches and inputs of one run."""

    allowlist: frozenset[str] = frozenset()
    orgs: tuple[str, ...] = ()
    ip: bool = False
    machines: bool = False
    paths: bool = False
    commands: bool = False
    certificates: bool = False
    nl_id: bool = False
    p2: bool = True
    harvest_names: bool = True
    single_token_names: bool = False
    expand_name_parts: bool = True
    scrub_orgs: bool = True
    recognise: bool = False
    ner_config: str | None = None
    irreversible: bool = False
    secret: bytes | None = None
    #: 'sequential': a value serves from the document on in which it was first seen; 'global': in all.
    visibility: str = "sequential"
    fields: PersonFields = field(default_factory=PersonFields)
    #: A dictionary of at most so many entries is broadcast; a larger one is joined by words.
    broadcast_entries: int = 50_000

    def technical(self) -> Options:
        """The bundle of technical kinds."""
        from dataclasses import replace

        return replace(self, machines=True, paths=True, commands=True, certificates=True)

    def kinds(self) -> list[str]:
        """The kinds found by their form, in the order of their passes."""
        switched = [("ip", self.ip), ("cert", self.certificates), ("path", self.paths), ("cmd", self.commands), ("machine", self.machines)]
        return [k for k, on in switched if on] + ["iban", "phone"] + ["bsn"] * self.nl_id + ["mac", "postcode", "dob"] * self.p2
