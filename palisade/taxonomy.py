"""Types, policies and rules as plain values.

Everything here is data: tables that queries join or fold into expressions. Patterns are
written in the dialect of the detectors' origin, where word boundaries and classes are
ASCII; ``functions.dialect`` turns them into Spark's and DuckDB's.
"""

from __future__ import annotations

from typing import NamedTuple


class Policy(NamedTuple):
    pii_type: str
    lifetime: str
    redaction: str
    threshold: float
    never_blur: bool
    confirm: bool


class PatternRule(NamedTuple):
    pii_type: str
    pattern: str
    confidence: float
    ignore_case: bool = False
    validator: str = ""
    context: str = ""
    #: What a text must have for the pattern to match at all: a cheap test before it.
    guard: str = ""
    #: Of which lower-case ASCII words a text or its context, in lower case, must hold one for the rule to match at all.
    words: tuple[str, ...] = ()
    #: Whether the guard finds a digit first and nothing that is over 8 characters from one: it is tested near digits alone.
    by_digit: bool = False


class LabelRule(NamedTuple):
    pii_type: str
    pattern: str
    confidence: float
    #: Lower-case words of which every match holds one: looked for before the pattern.
    words: tuple[str, ...] = ()


# Policy by type (lifetime, redaction, threshold, never blur, confirm before use).
POLICIES = [
    Policy("password", "session", "mask_solid", 0.2, True, True),
    Policy("otp", "ephemeral", "mask_solid", 0.2, True, True),
    Policy("cvv", "ephemeral", "mask_solid", 0.2, True, True),
    Policy("api_key", "session", "mask_solid", 0.3, True, True),
    Policy("secret_token", "session", "mask_solid", 0.3, True, True),
    Policy("aadhaar", "persistent", "placeholder", 0.35, True, True),
    Policy("pan", "persistent", "placeholder", 0.35, True, True),
    Policy("voter_id", "persistent", "placeholder", 0.4, True, True),
    Policy("passport", "persistent", "placeholder", 0.4, True, True),
    Policy("driving_licence", "persistent", "placeholder", 0.4, True, True),
    Policy("gstin", "persistent", "placeholder", 0.45, True, False),
    Policy("credit_card", "session", "placeholder", 0.3, True, True),
    Policy("bank_account", "persistent", "placeholder", 0.35, True, True),
    Policy("ifsc", "persistent", "placeholder", 0.5, False, False),
    Policy("upi_id", "persistent", "placeholder", 0.45, True, True),
    Policy("roll_number", "persistent", "synthetic", 0.5, False, False),
    Policy("registration_number", "persistent", "synthetic", 0.5, False, False),
    Policy("person_name", "persistent", "synthetic", 0.75, False, False),
    Policy("given_name", "persistent", "synthetic", 0.75, False, False),
    Policy("family_name", "persistent", "synthetic", 0.75, False, False),
    Policy("address", "persistent", "synthetic", 0.7, False, False),
    Policy("email", "persistent", "placeholder", 0.6, False, False),
    Policy("phone", "persistent", "placeholder", 0.55, False, False),
    Policy("date_of_birth", "persistent", "synthetic", 0.6, False, False),
    Policy("vehicle_number", "persistent", "placeholder", 0.6, False, False),
    Policy("face", "persistent", "blur", 0.5, False, False),
    Policy("signature", "persistent", "mask_solid", 0.5, True, False),
]

# Pattern rules in order of priority. \s stands for Unicode white space.
PATTERN_RULES = [
    PatternRule("gstin", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b", 0.97, True, "gstin", guard=r"[0-9][A-Za-z]{5}[0-9]", by_digit=True),
    PatternRule("aadhaar", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", 0.96, False, "aadhaar", guard=r"[2-9][0-9]{3}[^0-9]?[0-9]{4}[^0-9]?[0-9]{4}", by_digit=True),
    PatternRule("credit_card", r"\b(?:\d[ -]?){12,18}\d\b", 0.95, False, "payment_card", guard=r"(?:[0-9][ -]?){12}[0-9]", by_digit=True),
    PatternRule("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.94, True, "pan", guard=r"[0-9](?<=[A-Za-z]{5}[0-9])[0-9]{3}", by_digit=True),
    PatternRule("passport", r"\b[A-PR-WY][1-9]\d{6}\b", 0.88, True, "passport", guard=r"[0-9]{7}", by_digit=True),
    PatternRule("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.9, True, "ifsc", guard=r"0(?<=[A-Za-z]{4}0)", by_digit=True),
    PatternRule("email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.92, True, words=("@",)),
    PatternRule("upi_id", r"\b[A-Z0-9._-]{2,}@(?:ok[a-z]+|paytm|ybl|axl|upi|apl|ibl|sbi|hdfcbank|icici)\b", 0.9, True, guard=r"(?i)@(?:ok[a-z]|paytm|ybl|axl|upi|apl|ibl|sbi|hdfcbank|icici)", words=("@",)),
    PatternRule("phone", r"(?:\+?91[\s-]?)?\b[6-9]\d{4}[\s-]?\d{5}\b", 0.82, False, "indian_mobile", guard=r"[6-9][0-9]{4}[^0-9]?[0-9]{5}", by_digit=True),
    PatternRule("voter_id", r"\b[A-Z]{3}\d{7}\b", 0.7, guard=r"[0-9](?<=[A-Z]{3}[0-9])[0-9]{6}", by_digit=True),
    PatternRule("driving_licence", r"\b[A-Z]{2}[\s-]?\d{2}[\s-]?(?:19|20)\d{2}[\s-]?\d{7}\b", 0.85, True, guard=r"(?:19|20)[0-9]{2}[^0-9]?[0-9]{7}", by_digit=True),
    PatternRule(
        "api_key",
        r"\b(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:(?:or-v1|ant-(?:api\d{2})?|proj|svcacct)-)?[A-Za-z0-9_-]{16,}|gsk_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|npm_[A-Za-z0-9]{20,}|pypi-[A-Za-z0-9_-]{20,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|(?:shpat|shpca|shppa|shpss)_[A-Fa-f0-9]{20,}|(?:dop|doo|dor)_v1_[A-Fa-f0-9]{32,}|lin_api_[A-Za-z0-9]{20,}|(?:secret|ntn)_[A-Za-z0-9]{20,}|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|SK[0-9A-Fa-f]{32})\b",
        0.97, guard=r"(?:live|test|gsk|pat|gh[pousr]|hf|npm|shp(?:at|ca|pa|ss)|v1|lin_api|secret|ntn)_|(?:sk|glpat|xox[baprs]|pypi)-|AKIA|ASIA|AIza|SK[0-9A-Fa-f]{32}|SG\.",
        words=("_", "sk", "glpat-", "xox", "pypi-", "sg.", "akia", "asia", "aiza"),
    ),
    PatternRule(
        "secret_token",
        r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b|\b(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{12,}\b|\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis):\/\/[^\s:@/]+:[^\s@/]+@[^\s]+|-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]{16,}?-----END (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
        0.97, True, guard=r"(?i)eyJ|bearer|basic|(?:postgres|postgresql|mysql|mongodb|srv|redis)://|-----BEGIN",
        words=("eyj", "bearer", "basic", "://", "-----begin"),
    ),
    PatternRule(
        "api_key", r"\b[A-Za-z0-9][A-Za-z0-9._~+/=-]{15,511}\b", 0.88, False, "contextual_secret",
        r"\b(?:api|access|secret|client|developer|subscription|signing)[\s_-]*(?:key|secret)\b|\bclient[\s_-]*id\b", guard=r"[A-Za-z0-9._~+/=-]{16}",
        words=("key", "secret", "client"),
    ),
    PatternRule(
        "secret_token", r"\b[A-Za-z0-9][A-Za-z0-9._~+/=-]{15,511}\b", 0.88, False, "contextual_secret",
        r"\b(?:access|refresh|auth(?:entication|orization)?|bearer|session|personal[\s_-]*access|webhook|csrf)[\s_-]*(?:token|secret|cookie|key)?\b|\b(?:token|session[\s_-]*id|cookie)\b", guard=r"[A-Za-z0-9._~+/=-]{16}",
        words=("access", "refresh", "auth", "bearer", "session", "personal", "webhook", "csrf", "token", "cookie"),
    ),
    PatternRule("bank_account", r"\b\d{9,18}\b", 0.75, context=r"\b(?:a\/c|acc(?:oun)?t|bank)\b", guard=r"[0-9]{9}", words=("a/c", "acct", "account", "bank"), by_digit=True),
    PatternRule("roll_number", r"\b[A-Z0-9][A-Z0-9/-]{4,19}\b", 0.72, True, "portal_identifier", r"\b(?:roll|enrol(?:l)?ment|student\s*(?:id|no)|usn|prn)\b", guard=r"[0-9]", words=("roll", "enrol", "student", "usn", "prn"), by_digit=True),
    PatternRule("registration_number", r"\b[A-Z0-9][A-Z0-9/-]{4,19}\b", 0.72, True, "portal_identifier", r"\b(?:regd?|registration|admission|application)\s*(?:no|num|number|id)?\b", guard=r"[0-9]", words=("reg", "admission", "application"), by_digit=True),
    PatternRule("date_of_birth", r"\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b", 0.8, context=r"\b(?:d\.?o\.?b|date\s*of\s*birth|born|birth\s*date)\b", guard=r"[0-9][/.\-][0-9]", words=("dob", "d.ob", "do.b", "d.o.b", "birth", "born"), by_digit=True),
    PatternRule("vehicle_number", r"\b[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,3}[\s-]?\d{4}\b", 0.8, True, "vehicle_number", guard=r"[0-9][^0-9A-Za-z]?[A-Za-z]{1,3}[^0-9A-Za-z]?[0-9]{4}", by_digit=True),
    PatternRule("otp", r"\b\d{4,8}\b", 0.85, context=r"\b(?:otp|one[\s-]?time|verification\s*code|passcode|2fa|mfa)\b", guard=r"[0-9]{4}", words=("otp", "time", "verification", "passcode", "2fa", "mfa"), by_digit=True),
    PatternRule("cvv", r"\b\d{3,4}\b", 0.85, context=r"\b(?:cvv|cvc|csc|security\s*code|card\s*verification)\b", guard=r"[0-9]{3}", words=("cvv", "cvc", "csc", "security", "verification"), by_digit=True),
]

#: Fixed value: characters on either side of a match in which its context word may stand.
CONTEXT_WINDOW = 48

# Labelled values in order, with what follows the label as group 1; the last two end at a lookahead.
LABELLED_VALUES = [
    ("password", r"\b(?:password|passwd|pwd|login\s*pin)\s*(?:is|=|:)?\s*[\"']?([^\s\"',;]+)", True),
    ("api_key", r"\b(?:api|access|secret|client|developer|subscription|signing)[\s_-]*(?:key|secret)\s*(?:is|=|:)?\s*[\"']?([^\s\"',;]+)", True),
    ("secret_token", r"\b(?:access|refresh|auth|bearer|session|personal[\s_-]*access|webhook)[\s_-]*(?:token|secret|cookie)?\s*(?:is|=|:)?\s*[\"']?([^\s\"',;]+)", True),
    ("registration_number", r"\b(?:registration|application|admission)\s*(?:number|no|id)?\s*(?:is|=|:)\s*[\"']?([A-Z0-9][A-Z0-9/_-]{3,})", False),
    ("roll_number", r"\b(?:roll|student|enrolment|enrollment)\s*(?:number|no|id)?\s*(?:is|=|:)\s*[\"']?([A-Z0-9][A-Z0-9/_-]{3,})", False),
    ("person_name", r"\b(?:my\s+name|full\s+name|student\s+name)\s*(?:is|=|:)\s*[\"']?([\p{L}][\p{L} .'-]{1,60}?)(?=\s+(?:and|then|with|at|on|from)\b|[\",;\n]|\z)", False),
    ("address", r"\b(?:my\s+address|home\s+address|postal\s+address|address)\s*(?:is|=|:)\s*[\"']?([^\";\n]{5,160}?)(?=\s+(?:and|then)\b|[\";\n]|\z)", False),
]

#: Of which lower-case ASCII words a text must hold one for a labelled value's pattern to match at all.
LABEL_WORDS = dict(zip((pattern for _, pattern, _ in LABELLED_VALUES), [
    ("password", "passwd", "pwd", "login"), ("key", "secret"), ("access", "refresh", "auth", "bearer", "session", "personal", "webhook"),
    ("registration", "application", "admission"), ("roll", "student", "enrol"), ("name",), ("address",),
], strict=True))

# Words that are no credential although they follow a credential's label.
CREDENTIAL_STOP_WORDS = ["field", "value", "box", "input", "prompt", "manager", "reset", "again", "here", "below", "above"]

# HTML autocomplete tokens and what they declare.
AUTOCOMPLETE = {
    "current-password": "password", "new-password": "password", "one-time-code": "otp",
    "cc-number": "credit_card", "cc-csc": "cvv", "cc-name": "person_name", "cc-exp": "credit_card",
    "cc-exp-year": "credit_card", "cc-exp-month": "credit_card",
    "name": "person_name", "given-name": "given_name", "family-name": "family_name", "additional-name": "given_name",
    "email": "email", "username": "person_name", "tel": "phone", "tel-national": "phone",
    "bday": "date_of_birth", "bday-day": "date_of_birth", "bday-month": "date_of_birth", "bday-year": "date_of_birth",
    "street-address": "address", "address-line1": "address", "address-line2": "address",
    "address-level1": "address", "address-level2": "address", "postal-code": "address",
}
# Input types that declare their content, and the confidence of each kind of declaration.
INPUT_TYPES = {"password": "password", "email": "email", "tel": "phone"}
PASSWORD_INPUT_CONFIDENCE, INPUT_CONFIDENCE, AUTOCOMPLETE_CONFIDENCE = 0.99, 0.7, 0.9

# Label keywords in order, most specific first.
LABEL_RULES = [
    LabelRule("api_key", r"\b(?:api|access|secret|client|developer|subscription|signing)[\s_-]*(?:key|secret)\b|\bclient[\s_-]*id\b", 0.9, ("key", "secret", "client")),
    LabelRule("secret_token", r"\b(?:access|refresh|auth(?:entication|orization)?|bearer|session|personal[\s_-]*access|webhook|csrf)[\s_-]*(?:token|secret|cookie|key)?\b|\b(?:private[\s_-]*key|token|session[\s_-]*id|cookie)\b", 0.9, ("access", "refresh", "auth", "bearer", "session", "webhook", "csrf", "private", "token", "cookie")),
    LabelRule("password", r"\b(?:pass\s?word|passwd|pwd|pin)\b", 0.8, ("pass", "pwd", "pin")),
    LabelRule("otp", r"\b(?:otp|one[\s-]?time|verification\s*code|passcode)\b", 0.8, ("otp", "one", "code")),
    LabelRule("cvv", r"\b(?:cvv|cvc|csc|security\s*code)\b", 0.8, ("cvv", "cvc", "csc", "code")),
    LabelRule("aadhaar", r"\b(?:aadhaar|aadhar|uid(?:ai)?)\b", 0.75, ("aadha", "uid")),
    LabelRule("pan", r"\b(?:pan(?:\s*card)?|permanent\s*account)\b", 0.7, ("pan", "permanent")),
    LabelRule("passport", r"\bpassport\b", 0.7, ("passport",)),
    LabelRule("driving_licence", r"\b(?:driving|driver'?s)\s*licen[cs]e\b", 0.7, ("licen",)),
    LabelRule("voter_id", r"\b(?:voter|epic)\s*(?:id|card|no)\b", 0.7, ("voter", "epic")),
    LabelRule("gstin", r"\bgst(?:in)?\b", 0.7, ("gst",)),
    LabelRule("credit_card", r"\b(?:card\s*(?:no|number)|debit|credit\s*card)\b", 0.75, ("card", "debit")),
    LabelRule("bank_account", r"\b(?:a\/c|account)\s*(?:no|number)\b", 0.7, ("a/c", "account")),
    LabelRule("ifsc", r"\bifsc\b", 0.75, ("ifsc",)),
    LabelRule("upi_id", r"\b(?:upi|vpa)\b", 0.7, ("upi", "vpa")),
    LabelRule("roll_number", r"\b(?:roll\s*(?:no|number)?|usn|prn)\b", 0.7, ("roll", "usn", "prn")),
    LabelRule("registration_number", r"\b(?:regd?|registration|admission|enrol(?:l)?ment)\s*(?:no|number|id)\b", 0.7, ("reg", "admission", "enrol")),
    LabelRule("date_of_birth", r"\b(?:d\.?o\.?b|date\s*of\s*birth)\b", 0.75, ("dob", "d.o", "do.b", "birth")),
    LabelRule("vehicle_number", r"\b(?:vehicle|registration\s*plate|number\s*plate)\b", 0.7, ("vehicle", "plate")),
    LabelRule("address", r"\b(?:address|street|locality|city|town|district|state|pin\s*code|pincode|postal|zip)\b", 0.78, ("address", "street", "locality", "city", "town", "district", "state", "pin", "postal", "zip")),
    LabelRule("email", r"\b(?:e-?mail)\b", 0.7, ("mail",)),
    LabelRule("phone", r"\b(?:phone|mobile|contact\s*(?:no|number)|tel|whatsapp)\b", 0.75, ("phone", "mobile", "contact", "tel", "whatsapp")),
    LabelRule("given_name", r"\b(?:first|given|fore)\s*name\b", 0.8, ("name",)),
    LabelRule("family_name", r"\b(?:last|family|sur)\s*name\b|\bsurname\b", 0.8, ("name",)),
    LabelRule("person_name", r"\b(?:(?:middle|full|your|student|applicant|candidate|holder|father'?s?|mother'?s?|guardian'?s?|spouse'?s?)\s*name|name\s*(?:of\s*(?:the\s*)?(?:applicant|student|candidate|holder))?)\b", 0.8, ("name",)),
]

# Types whose separators are cosmetic, and the least length of a value that is searched for.
SEPARATOR_INSENSITIVE = [
    "aadhaar", "pan", "credit_card", "bank_account", "ifsc", "phone", "passport", "driving_licence", "voter_id",
    "gstin", "roll_number", "registration_number", "vehicle_number", "date_of_birth",
]
LEAST_SEARCHABLE = 5

# The dihedral group's multiplication and the position permutations of the Verhoeff check.
VERHOEFF_PRODUCT = [
    "0123456789", "1234067895", "2340178956", "3401289567", "4012395678",
    "5987604321", "6598710432", "7659821043", "8765932104", "9876543210",
]
VERHOEFF_PLACE = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]
