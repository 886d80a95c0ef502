"""Fixed values of the public contract: word lists, names, limits, states."""

# Fixed values. Words that never count as terms.
STOP_WORDS = (
    "the a an and or of to in for on at is are was be with how does do did what where when which "
    "who why by from it its this that as before after not any one all between during into out over under"
).split()
# Fixed values. Endings a stem loses: the first that leaves three letters.
SUFFIXES = ("ing", "ed", "es", "s")

# Fixed values. Directories that are never entered, and tools' own ones among them.
TOOL_DIRS = (".delegate", ".claude", ".codex", ".cursor", ".vscode", ".idea", ".desloppify", ".tldr")
BUILD_DIRS = (".git", "target", "node_modules", "dist", "build", "__pycache__", ".venv", "venv")
INDEX_DIR = ".cartulary"
# Names of files with ignore rules, those that win first.
IGNORE_FILES = (".cartularyignore", ".ignore", ".gitignore")

# Fixed values. Extensions of files that hold no text.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "zip", "gz", "tar", "ico", "woff", "woff2", "map", "lock", "jsonl", "svg", "mp4", "mp3", "heic",
)
# Fixed values. Extensions of prose.
PROSE_EXTENSIONS = ("md", "markdown", "txt", "rst")

# Fixed values. What makes a path sensitive.
SECRET_DIRS = (".ssh", ".aws", ".kube", ".docker", ".gnupg", ".azure")
SECRET_NAMES = (".netrc", ".npmrc", ".pypirc", ".pgpass", ".htpasswd")
SSH_KEYS = ("id_rsa", "id_ed25519", "id_ecdsa", "id_dsa")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".crt", ".cer", ".pfx", ".jks", ".keystore", ".ppk", ".asc", ".gpg")

# Fixed values. Names of files about a project rather than of it.
AGENT_FILES = ("CLAUDE.md", "AGENTS.md")
META_NAMES = (
    "LICENSE", "LICENSE.md", "COPYING", "Cargo.lock", "package-lock.json", "pnpm-lock.yaml",
    "yarn.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "go.sum",
)

# Fixed values. States and exit codes.
STATES = {
    "ok": 0, "internal_error": 1, "usage_error": 2, "partial": 3, "unanswered": 4,
    "budget_hit": 10, "index_stale": 11, "index_missing": 12, "provider_error": 13, "tool_degraded": 14,
}
COMMANDS = ("index", "brief", "capabilities", "schema", "doctor", "eval", "help")

# Fixed values. Limits and rates.
MAX_FILE_BYTES = 300_000
CANDIDATES = 20
CHUNK_LINES, CHUNK_OVERLAP, CHUNK_CAP = 350, 25, 24
SCORED_CHARS, CARD_CHARS, ROLE_CHARS = 20_000, 16_000, 160
LINE_TOLERANCE = 5
COVER_OVERLAP, POISON_OVERLAP, WEAK_RATIO = 0.5, 0.6, 0.4
PACK_BASE = 200
USD_IN, USD_OUT = 2.15, 2.70
CALLS_PER_MINUTE = 450
REFRESH_USD = 0.25
CHURN_DAYS = 90

# Fixed values. Words that relate a claim to its source.
CLAIM_WORDS = ("claim", "cover", "creat", "describe", "include", "say")
POISON_WORDS = ("ask", "claim", "cover", "creat", "describe", "include", "make", "mention", "say", "state")
RESTRICTORS = ("only", "solely", "merely", "exclusively", "just")
RESTRICTING = ("limited to", "no more than")
COUNTER = ("does not", "doesn't", "not ", "no ", "never", "without", "rather than", "instead of")
GENERIC = ("The", "A", "An", "This", "That", "It", "Where", "When", "How", "What")
CLAIM_PREFIX = "where does the corpus say "
