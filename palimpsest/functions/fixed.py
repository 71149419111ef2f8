"""Word lists, patterns and formats that results depend on."""

# --- kinds, with the name their store has in a saved map ---
STORES = {
    "email": "emails", "username": "usernames", "person": "names", "org": "orgs", "ip": "ips", "phone": "phones",
    "iban": "ibans", "bsn": "bsns", "mac": "macs", "postcode": "postcodes", "dob": "dobs", "machine": "machines",
    "path": "paths", "cmd": "commands", "cert": "certs",
}
KINDS = list(STORES)
RESIDUAL_KINDS = ["email", "iban", "phone", "bsn", "mac", "postcode", "dob"]
HIGH_CONFIDENCE = ["email", "iban"]

# --- file kinds ---
TEXT_SUFFIXES = [".md", ".txt", ".xml", ".html", ".htm", ".json", ".js", ".eml", ".csv", ".tsv", ".log", ".yml", ".yaml"]
BINARY_SUFFIXES = [".xlsx", ".xls", ".pdf"]
EXPORT_DIRS = ["source-export", "source_export"]

# --- names ---
PARTICLES = "van de der den het ter ten te tot von da di dos das del la le el 't t".split()
DENY = (
    "test user users name names person people email mail admin system guest true false null none data file path type code case"
    " from with that this when what will have been were your into only also over such than then them they their there where which"
    " while about after before under above other value field label error event script action record table update create delete"
    " import export config default example sample string number object array boolean return class function method module package"
    " service client server request response status state order group role team core portal original"
    " the and or not for are was can may has had does did but its his her our any all each both few more most some no nor own"
    " same so too very just how why who whom via per new old raw set get put add use used using run runs step flow form page link"
    " list item left right side open opened valid invalid dot walk see below section summary fix fixes notes"
    " een van het voor met niet ook nog als bij uit aan tot door naar deze die dat"
).split()
PROBES = (
    "not user test the and or for are was can has had but its our any all new old set get use run valid invalid niet voor met ook als"
).split()

# --- person fields ---
XML_TAGS = "opened_by requested_for caller_id assigned_to consumer closed_by contact watch_list sys_created_by sys_updated_by u_requested_for u_caller".split()
JSON_KEYS = "opened_by requested_for caller_id assigned_to consumer closed_by contact watch_list".split()
CSV_HEADERS = (
    "naam name full_name fullname caller caller_id reporter reporters stakeholder stakeholders assignee assigned_to opened_by"
    " requested_for contact consumer watch_list"
).split()
LABELS = [
    "reporter", "reporters", "stakeholder", "stakeholders", "assignee", "assignees", "assigned to", "opened by", "requested for",
    "caller", "caller id", "consumer", "contact", "submitted by", "watch list", "reported by",
]
LOGIN_EVENTS = ["login", "login.failed"]

# --- patterns; each holds in Python and in Java alike ---
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,63}"
NAME_ANGLE = r"([A-Za-z][A-Za-z0-9 .'_-]{0,80}?)\s*<\s*(" + EMAIL + r")\s*>"
AUDIT_XML = r"(<(?:sys_created_by|sys_updated_by)>)([^<]+)(</(?:sys_created_by|sys_updated_by)>)"
AUDIT_JSON = r'("(?:sys_created_by|sys_updated_by)"\s*:\s*")([^"]+)(")'
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = r"\b(?:" + OCTET + r"\.){3}" + OCTET + r"\b"
IPV6 = (
    r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:[0-9A-Fa-f]{0,4}"
    r"|:(?::[0-9A-Fa-f]{1,4}){1,7}"
    r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
)
PHONE = (
    r"(?<!\w)(?:\+31[\s\-.]?(?:\d[\s\-.]?){8,9}\d"
    r"|0\d[\s\-.]?(?:\d[\s\-.]?){7,8}\d"
    r"|\+(?:1|3[0-9]|4[0-9]|5[0-9])[\s\-.]?(?:\d[\s\-.]?){7,12}\d)(?!\w)"
)
IBAN = r"\b([A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2}(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,4})?)\b"
BSN_LABELLED = r"\b(?:bsn|burgerservicen(?:ummer)?)\b\s*[:=]?\s*(\d{8,9})\b"
BSN_BARE = r"(?<!\d)(\d{9})(?!\d)"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
POSTCODE_BARE = r"\b([1-9]\d{3}\s?[A-Za-z]{2})\b"
POSTCODE_STREET = r"\b([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-']{2,40}\s+\d{1,5}[a-zA-Z]?)\s*,?\s*([1-9]\d{3}\s?[A-Za-z]{2})\b"
DOB = r"\b(?:dob|date\s*of\s*birth|geboortedatum|birth\s*date)\b\s*[:=]?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
MACHINE_LABEL = r"\b(?:hostname|host|machine(?:-|\s)?name|computer(?:\s+name)?)\s*[:=]\s*"
MACHINE = "(" + MACHINE_LABEL + r")([A-Za-z0-9][A-Za-z0-9._-]{0,62})"
PATH_WINDOWS = r"(?<![@\w])([A-Za-z]:\\(?:[^\s\"'<>|\r\n]+\\?)+)"
PATH_UNIX = r"(?<![@\w:])(/(?:home|Users|tmp|opt|var|mnt)/[^\s\"'<>|\r\n]+)"
COMMAND = r"^(?:[\$>]+\s*)?(?:py(?:thon)?(?:\s+-3)?|powershell|pwsh|Get-Content|curl|git|npm|node|bash|sh)\b[^\n]{0,500}"
PEM_BEGIN, PEM_END = r"-----BEGIN [A-Z0-9 ]+-----", r"-----END [A-Z0-9 ]+-----"
PEM_MOST_CHARS = 65536
TICKET = r"(?:INC|RITM|REQ|TASK|CS|ESM|STRY|PRB|KB|CHG)\d+"
SYS_ID = r"[0-9a-f]{32}"
PSEUDO_TOKEN = (
    r"(?:PERSON_(?:SHORT|\d+)|ORG_\d+|username_\d+|PHONE_\d+|IBAN_\d+|MACHINE_\d+|PATH_\d+|CMD_\d+|CERT_\d+"
    r"|REDACTED_[A-Z]+_[0-9a-f]+|(?:UHMASKEDADDR_)?user_\d+@example\.test)"
)
SCRUBBED_PREFIXES = ["MACHINE_", "PATH_", "CMD_", "CERT_"]
TABLE_ROW = r"^\s*\|(.+)\|\s*$"
HEADING_BULLETS = (
    r"^[ \t]*(?:#{1,6}[ \t]+)?\*{0,2}[ \t]*([^\n|*]{2,80}?):\*{0,2}[ \t]*\n"
    r"((?:[ \t]*[-*•].+(?:\n|$))+)"
)
LIST_SPLIT = r"\s*(?:[/;,]|&|\band\b|\ben\b)\s*"
TEST_WITH = r"\btest(?:ed)?\s+with\s+([^:<\n]+?)(?:\s*:|\s*$)"
SYSEVENT = r"<sysevent\b[^>]*>(.*?)</sysevent\s*>"
SYSEVENT_NAME = r"<name>\s*([^<]*?)\s*</name>"
SYSEVENT_PARM = r"<(parm[12])\b[^>]*>([^<]*)</\1\s*>"

# --- staged paths that are refused ---
DENIED_GLOBS = [".env", ".env.*", ".local/pii-map*", "*.key", "**/pii-map.json", "**/pii-map.json.bak"]
QUARANTINE = ["inbox/raw/", "inbox/instance-upload/", "inbox/clean/"]
STORIES = "src/stories/"

# --- fixed values: markup, and where names stand; % is the list of labels, tags or keys ---------
BREAKS = r"<br\s*/?>|</?p>|<li[^>]*>"
TAGS_BOLD = r"<[^>]+>|\*\*"
BULLET = r"^[-*•]+\s*"
LABEL_LINE = r"^\s*(?:%)(?:\s*\([^)]*\))?\s*:?\s*$"
XML_DISPLAY = r"<(?:%)\b[^>]*\bdisplay_value=(['\"])(.*?)\1"
JSON_DISPLAY = r'"(?:%)"\s*:\s*\{[^{}]*?"display_value"\s*:\s*"([^"]+)"'
SERVICE_USERS = ["guest", "system"]
