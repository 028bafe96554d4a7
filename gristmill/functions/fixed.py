"""What results depend on and no rule derives."""

#: Secret patterns, applied in this order; each whole match becomes the placeholder. RE2 and Java read them alike.
SECRETS = [
    r"""(?i)(api[_-]?key|apikey|api[_-]?secret)\s*[:=]\s*["']?([A-Za-z0-9/+=_-]{20,})["']?""",
    r"AKIA[0-9A-Z]{16}",
    r"""(?i)(aws[_-]?secret[_-]?access[_-]?key)\s*[:=]\s*["']?([A-Za-z0-9/+=]{40})["']?""",
    r"""(?i)(secret|token|password|passwd|credential)\s*[:=]\s*["']([^"']{8,})["']""",
    r"""(?i)(secret|token|password|passwd|credential)\s*[:=]\s*([^\s"']{8,})""",
    r"(?i)Bearer\s+[A-Za-z0-9._/+=-]{20,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"-----BEGIN\s+(RSA\s+)?PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9_]{36,}",
    r"xox[bporas]-[A-Za-z0-9-]{10,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"""(?i)(mongodb|postgres|postgresql|mysql|redis|amqp)://[^\s"']+:[^\s"'@]+@[^\s"']+""",
    r"""(?i)(key|secret|token)\s*[:=]\s*["']?[0-9a-f]{32,}["']?""",
]
#: What a text must hold for any of these patterns to match.
#: akia, secret, token, passw, credential, bearer, eyj, key, gh[pousr]_, xox[bporas]-, sk- or ://, in any case. All of them turn on a letter that texts have
#: few of, so most characters are passed by one look at a set, not by a try of each part.
SECRET_PARTS = r"[kKcCbBwWjJxX:_](?i:(?<=k)(?:ey|en(?<=token)|ia(?<=akia)|-(?<=sk-))|(?<=c)(?:redential|ret(?<=secret))|(?<=b)earer|(?<=passw)|(?<=eyj)|(?<=x)ox[bporas]-|(?<=:)//|(?<=gh[pousr]_))"
#: Remote URLs of a repository: owner and name.
REMOTES = [r"https?://[^/]+/([^/]+)/([^/.\s]+)", r"[^@]+@[^:]+:([^/]+)/([^/.\s]+)"]
PLACEHOLDER = "[REDACTED]"
PATH_PLACEHOLDER = PLACEHOLDER + " (file content redacted by path policy)\n"

#: Language names by file suffix, for prompts.
LANGUAGES = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript/React", ".jsx": "JavaScript/React", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".cpp": "C++", ".c": "C",
    ".h": "C/C++", ".cs": "C#", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".sql": "SQL", ".sh": "Shell", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".tf": "Terraform",
}

#: Names of code fences by file suffix, for Markdown.
FENCES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".rs": "rust", ".java": "java", ".rb": "ruby", ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".php": "php",
    ".sh": "bash", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".tf": "hcl",
}

#: A suggestion that holds any of these is shown as code.
CODE_MARKS = ["func ", "if ", "for ", "return ", "var ", "const ", "def ", "class ", "import ", "from ", "{", "}", "=>", "->", ":=", "==", "()", "[];"]

SEVERITIES = ["low", "medium", "high"]
CATEGORIES = ["bug", "security", "performance", "correctness", "style", "maintainability", "testing", "docs"]
SARIF_LEVELS = {"high": "error", "medium": "warning"}
TEXT_ICONS = {"high": "[!!]", "medium": "[!]", "low": "[-]"}
MARKDOWN_ICONS = {"high": ":red_circle:", "medium": ":orange_circle:", "low": ":yellow_circle:"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"

CHUNK_TRIGGER_BYTES = 100_000
FILE_BYTES = 1 << 20
CONCURRENT_CALLS = 4
RESPONSE_TOKENS = 8192
