"""Word lists and patterns which decide results and so are stated as they are."""

# Directory-traversal literals, case-sensitive, matched against the undecoded URL.
TRAVERSAL_WORDS = (
    "\\..\\..\\..\\..\\..\\..\\",
    "/../../../../../../",
    "\\\\..\\\\..\\\\..",
    "/\\..\\..\\..\\..\\",
    "/????/????/????/",
    "/\\x5c\\x5c../",
    "..\\../../..\\",
    "/..%5c..%5c..%5c..",
    "/..%5C..%5C..%5C..",
    "/..%5c../",
    "/..%5C../",
    "../%5c../%5c../%5c..",
    "../%5C../%5C../%5C..",
    "%5C..%5C..%5C..",
    "%5c..%5c..%5c..",
    "%2f..%2f..%2f..",
    "%2F..%2F..%2F..",
)

# Suspicious words of an injected URL, counted without regard to case, earliest alternative first.
SUSPICIOUS_WORDS = (
    "alert",
    "onMouseOver",
    "expression",
    "confirm",
    "onfocus",
    "href",
    "script",
    "cookie",
    "script=%3c",
    "onerror",
    "onload",
    "eval",
    "src=",
    "prompt",
    "http",
    "https",
)

SUSPICIOUS_CHARS = "[<>,/]"

# A word character is a letter, a number or "_" of any script.
_W = r"[\p{L}\p{N}_]"
_WD = r"[\p{L}\p{N}_.]"

# The eleven token shapes, in order of preference.
ATTACK_TOKEN = "|".join(
    (
        _WD + r"+?\(",
        r"\)",
        '"' + _W + '+?"',
        "'" + _W + "+?'",
        "http://" + _W,
        "</" + _W + "+>",
        "<" + _W + "+>",
        "<" + _W + "+",
        _W + "+=",
        ">",
        _WD + "+",
    )
)

EMBEDDED_URL = r"(http|https)://[a-zA-Z0-9\.@&#!#\?]+"
CJK_RUN = "[一-龥]+"
BASE64_CALL = r"base64_decode\((.*?)\)"
