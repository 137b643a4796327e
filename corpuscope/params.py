"""Default limits and sizes (fixed values; each operator takes them as arguments)."""

# chunking
CHUNK_MAX_CHARS = 500
CHUNK_MAX_CHARS_FLOOR = 200
CHUNK_MIN_CHARS = 120
CHUNK_OVERLAP_LINES = 3
PARAGRAPH_MAX_LINES = 40
HEADER_SCAN_LINES = 30
EMBED_BATCH = 128
EMBED_DIM = 384

# retrieval
SEARCH_TOP_K = 10
CHAT_TOP_K = 5
TOOL_TOP_K = 5
PREVIEW_CHARS = 200
CONTEXT_CHARS = 2000
TOOL_SNIPPET_CHARS = 2000
READ_MAX_LINES = 400
READ_MAX_CHARS = 20_000
LIST_MAX_FILES = 1000
GREP_MAX_FILES = 300
GREP_MAX_MATCHES = 50
GREP_LINE_CHARS = 400
FILTER_MAX_ROWS = 300

# symbol graph
CALLERS_LIMIT = 50
CALLEES_LIMIT = 60
CALLEE_CANDIDATES = 3
REFERENCED_BY_LIMIT = 20
SIMILAR_NAMES = 5

# conversations
HISTORY_MESSAGES = 8
HISTORY_CHARS = 2000
CONTEXT_BUDGET_CHARS = 60_000
SUMMARY_THRESHOLD = 6
TITLE_CHARS = 40
DEFAULT_TITLE = "New Chat"

# jobs
JOB_MAX_ATTEMPTS = 3
JOB_STALE_SECONDS = 300
BACKOFF_BASE_SECONDS = 30

# request limits: bucket -> requests per window
RATE_LIMITS = {"AUTH": 5, "CHAT": 20, "AGENT": 20, "SEARCH": 20}
RATE_WINDOW_MS = 60_000

# archives
MAX_FILE_BYTES = 1_000_000
MAX_ARCHIVE_FILES = 5000
MAX_ARCHIVE_BYTES = 250 * 1024 * 1024

# evaluation
EVAL_KS = (5, 10)
GATE_EPSILON = 1e-9

# debug reports
EVIDENCE_FILES = 5
EVIDENCE_CHARS = 4000
EVIDENCE_WINDOW = 25
EVIDENCE_GREP_MATCHES = 20
