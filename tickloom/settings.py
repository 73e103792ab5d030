"""Defaults and fixed lists.

Every operator takes these as arguments; the values here are only the defaults.
"""

# --- Fixed values: thresholds -------------------------------------------------
SIMILARITY_THRESHOLD = 0.85
FORCED_SNAPSHOT_S = 45
MAX_TEXT_COMPARE = 2000
IDLE_TIMEOUT_S = 180
MAX_TEXT_LENGTH = 20000
MIN_TEXT_LENGTH = 50
NATIVE_TREE_DEPTH = 10
WEB_SEARCH_DEPTH = 10
WEB_CONTENT_DEPTH = 15
MIN_WINDOW_SIDE = 100
BOUNDS_TOLERANCE = 5
# Up to so many elements of a process are held together, as one row.
FEW_ELEMENTS = 64
RECENT_MINUTES = 10
CAPTURE_LIMIT = 500
SEARCH_LIMIT = 50
EVENT_LIMIT = 100
COOLDOWN_S = 600
COOLDOWN_DISMISSED_S = 1800
SESSION_GAP_S = 120
TICK_SECONDS = 3

# Length of the time slices that sequences are cut into. A slice of one key is
# the most that one task sorts, so data with a very busy key wants short ones;
# every slice costs one small row.
SLICE_S = 3600
# The same where a row depends on what was kept before it. Rows of a sequence are
# streamed, so a long slice costs no memory.
RECURRENCE_SLICE_S = 86_400

# --- Fixed values: owners that are never user windows -------------------------
SYSTEM_OWNERS = [
    "Control Center",
    "Dock",
    "Finder Desktop",
    "Hidden Bar",
    "Notification Center",
    "Screenshot",
    "SystemUIServer",
    "TextInputMenuAgent",
    "Wallpaper",
    "Window Server",
    "WindowManager",
    "Wispr Flow",
]

# --- Fixed values: privacy lists ----------------------------------------------
BLOCKED_APPS = [
    "1Password",
    "Bitwarden",
    "LastPass",
    "Dashlane",
    "KeePassXC",
    "Keychain Access",
    "Passwords",
]
SECURE_SUBROLES = ["AXSecureTextField"]
SENSITIVE_URL_KEYS = [
    "token",
    "auth",
    "password",
    "passwd",
    "secret",
    "key",
    "api_key",
    "apikey",
    "access_token",
    "refresh_token",
    "session",
    "signature",
    "billing",
    "credit",
    "card",
    "cvv",
    "ssn",
]
PRIVATE_TITLE_PATTERNS = [
    r"private browsing",
    r"incognito",
    r"inprivate",
    r"private window",
]
PRIVATE_ATTRIBUTE_WORDS = ["incognito", "private"]
SENSITIVE_TITLE_PATTERNS = [
    r"password\s*manager",
    r"passwords?\s*[-—]",
    r"saved\s*passwords?",
    r"keychain",
    r"credentials?",
    r"autofill",
    r"credit\s*card",
    r"payment\s*method",
    r"billing\s*info",
    r"bank\s*account",
]
SENSITIVE_CONTENT_PATTERNS = [
    r"copy\s*password",
    r"hide\s*password",
    r"show\s*password",
    r"edit\s*password",
    r"delete\s*password",
    r"copy\s*username",
    r"search\s*passwords",
    r"card\s*number",
    r"expir(y|ation)\s*date",
    r"security\s*code",
    r"cvv",
    r"routing\s*number",
    r"account\s*number",
]

# --- Fixed values: app lists for the attention reports ------------------------
DISTRACTION_APPS = ["Twitter", "Reddit", "YouTube", "Instagram", "TikTok"]
FOCUS_APPS = ["Code", "Terminal", "iTerm2", "Cursor", "Xcode"]

# --- Fixed values: labels written into rows -----------------------------------
BUCKET_PREFIX = "aw-watcher"
EVENT_SOURCE = "aw"
BLOCKED_TITLE = "[blocked]"
PRIVATE_TITLE = "[private window]"
SENSITIVE_TITLE = "[sensitive page]"
REDACTED = "[REDACTED]"
TEXT_SEPARATOR = " | "
IDLE_APP = "IDLE"
ERROR_APP = "ERROR"
UNKNOWN_APP = "Unknown"
WEB_ROLE = "AXWebArea"
