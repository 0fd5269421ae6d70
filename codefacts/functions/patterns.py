"""Fixed values that results depend on."""

# Names that suggest a value must not be stored.
SENSITIVE = ("passwd", "password", "secret", "token", "api_key", "apikey", "auth", "credential", "private_key", "session", "cookie")

# What marks a test file, a test definition, an assertion and its weakening.
TEST_FILE = r"(?i)(^|[\\/])(tests?|__tests__|spec)([\\/]|$)|\.(test|spec)\.[jt]sx?$|(^|[\\/])test_[^\\/]+\.py$|_test\.(py|go|rb)$"
TEST_DEF = (r"^\s*def\s+test_\w+", r"^\s*(it|test)\s*\(", r"^\s*func\s+Test\w+", r"^\s*(it|specify|scenario)\s+['\"]")
ASSERTION = (
    r"^\s*(assert\s|assert\()",
    r"\bexpect\s*\(",
    r"\bassert(Equal|True|False|In|Is|Raises|AlmostEqual|Greater|Less|Regex)\w*\s*\(",
    r"^\s*\w*\.?(should|must)\b",
    r"\bt\.(is|deepEqual|truthy|falsy|throws)\(",
)
SKIP = (
    r"^\s*@pytest\.mark\.(skip|skipif|xfail)",
    r"^\s*@unittest\.skip",
    r"^\s*(it|test|describe)\.(skip|todo|failing)\s*\(",
    r"^\s*x(it|test|describe)\s*\(",
    r"^\s*pytest\.skip\s*\(",
)
WEAKENER = (
    r"pytest\.approx\s*\(",
    r"assertAlmostEqual\s*\(",
    r"\.(toBeTruthy|toBeDefined|toBeInstanceOf)\s*\(",
    r"^\s*assert\s+(True|1)\s*($|,|#)",
    r"\bor\s+True\b",
    r"\|\|\s*true\b",
    r"(?i)expect\s*\(\s*true\s*\)",
)
COMPARES = r"(==|!=|<=|>=|<|>|\bin\b|\bis\b|\.raises|approx)"

# How frames of each runtime's own library begin or what they contain.
LIBRARY = {
    "js": ("node:", "internal/", "node_modules/", "node_modules\\"),
    "ts": ("node:", "internal/", "node_modules/", "node_modules\\"),
    "java": ("java.", "javax.", "jdk.", "sun."),
    "csharp": ("System.", "Microsoft."),
    "ruby": ("<internal:",),
    "php": ("/vendor/", "\\vendor\\"),
    "go": ("/usr/local/go/", "runtime/"),
    "rust": ("/rustc/",),
}
#: Runtimes whose hooks write the innermost frame first.
INNERMOST_FIRST = ("js", "ts", "java", "csharp", "ruby", "php", "go", "rust", "lua")

# Language, extensions, suffixes and folders of tests, whether a selection may be narrowed.
LANGUAGES = (
    ("python", (".py",), ("_test",), ("test", "tests"), True),
    ("js", (".js", ".mjs", ".cjs", ".jsx"), (".test", ".spec"), ("test", "tests", "__tests__", "spec"), True),
    ("ts", (".ts",), (".test", ".spec"), ("test", "tests", "__tests__", "spec"), True),
    ("tsx", (".tsx",), (".test", ".spec"), ("test", "tests", "__tests__"), False),
    ("go", (".go",), ("_test",), ("test", "tests"), True),
    ("rust", (".rs",), (), ("tests",), True),
    ("java", (".java",), ("Test", "Tests"), ("test", "tests"), True),
    ("kotlin", (".kt",), ("Test",), ("test", "tests"), False),
    ("csharp", (".cs",), ("Test", "Tests"), ("test", "tests"), True),
    ("ruby", (".rb",), ("_test", "_spec"), ("test", "tests", "spec"), True),
    ("php", (".php",), ("Test",), ("test", "tests"), True),
    ("lua", (".lua",), ("_test", "_spec"), ("test", "tests", "spec"), True),
    ("scala", (".scala",), ("Test", "Spec"), ("test", "tests"), False),
    ("c", (".c", ".h"), ("_test",), ("test", "tests"), False),
    ("swift", (".swift",), ("Test", "Tests"), ("test", "tests"), False),
    ("dart", (".dart",), ("_test",), ("test", "tests"), False),
    ("elixir", (".ex", ".exs"), ("_test",), ("test", "tests"), False),
)
TEST_SUFFIXES = tuple(sorted({"_test", "_spec"} | {s for x in LANGUAGES for s in x[2]}))
TEST_DIRS = tuple(sorted({"test", "tests", "spec", "__tests__"} | {d for x in LANGUAGES for d in x[3]}))

#: A quoted piece of a line that may name a file.
QUOTED = r"""["']([^"']{2,160})["']"""
TEMPORARY = ("/tmp", "/var/tmp")
REDACTED = "<redactado>"
