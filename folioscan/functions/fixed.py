"""Results depend on these staying exactly as they are."""

# --- characters -----------------------------------------------------------------------------
# White space as str.split / str.strip see it, once as a regex class body and once as text.
# Java tests the Latin-1 part with one bit set; the nested range keeps other text off the long list.
WS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SENTENCE_END = ".!?;:¿¡。！？；："
LOOKBACK_PUNCT = "。！？；：.!?;:¿¡"
# CJK code-point ranges: unified ideographs, extensions A to F, symbols, full-width forms.
CJK_RANGES = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
)

# --- text quality thresholds ----------------------------------------------------------------
MIN_CHARS = 10
MOJIBAKE_MAX = 0.10
WHITESPACE_MIN = 0.05
WHITESPACE_MAX = 0.70
NONWORD_MAX = 0.30

# --- segmentation limits --------------------------------------------------------------------
MAX_SENTENCE = 5000
MIN_SENTENCE = 20
SEGMENT_CHARS = 200
CHUNK_WORDS = 2500
NUM_CTX = 32768
NUM_PREDICT = 4096
PART_HOURS = 14.0
MIN_BATCH_CHARS = 200
SHORT_SCRIPT_WORDS = 200
MIN_CONTENT_CHARS = 100

# --- narration and fidelity -----------------------------------------------------------------
WORDS_PER_MINUTE = 75
WER_MAX = 0.3
WINDOW_S = 8.0
FIDELITY_RATIO_MIN = 0.5
CHAPTER_RATIO_MIN = 0.7
BOOK_RATIO_MIN = 0.6
PRESERVATION_MIN = 0.60
FAILURE_RATE_MAX = 0.05
MAX_CONSECUTIVE_FAILURES = 5

# --- retry cycles, in report order ----------------------------------------------------------
BUDGET = 3
CYCLES = ("cycle_1_escalation", "cycle_2_reroute", "cycle_3_retry")

# --- front and back matter, tables of contents, copyright pages -------------------------------
SKIP_NAME_TOKENS = (
    "toc", "nav", "titlepage", "cover", "cubierta", "sinopsis", "synopsis", "titulo", "título",
    "colophon", "bio", "notes", "notas", "appendix", "apendice", "apéndice", "index", "indice",
    "índice", "bibliography", "bibliografía", "references", "referencias",
)
TOC_INDICATORS = ("table of contents", "contents", "目录", "chapter", "part", "section", "章")
COPYRIGHT_INDICATORS = (
    "copyright", "©", "isbn", "published by", "all rights reserved", "责任编辑", "封面设计",
    "图书在版编目",
)
TOC_TYPES = ("toc", "table-of-contents")
CONTENT_TYPES = (
    "chapter", "bodymatter", "introduction", "preface", "epilogue", "conclusion", "appendix",
    "dedication", "foreword", "afterword", "prologue", "glossary", "bibliography", "index",
    "notes", "epigraph",
)
CJK_CHAPTER = r"第[一二三四五六七八九十\d]+章"
MIN_TOC_MATCHES = 3

# --- chapter headings -----------------------------------------------------------------------
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
NAMED_SECTIONS = (
    "prologue|epilogue|introduction|foreword|preface|afterword|appendix"
    "|acknowledgments|dedication|interlude|intermission"
)
TITLE_TOKENS = (
    "title|heading|chapter|chaptertitle|chaptitle|chapter-title|chapter-head|chapter-heading"
    "|book-title|section-title|calibre_heading|sgc-toc-level"
)

# Where titles are looked for without headings: nodes, lines and blocks at the start of the body.
TITLE_EARLY_NODES, TITLE_EARLY_LINES, TITLE_EARLY_BLOCKS = 10, 10, 5
TITLE_EMPHASIS_CHARS, TITLE_LINE_CHARS, TITLE_LINE_WORDS = 150, 80, 12
# Elements that have no end tag and no content.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
                 "track", "wbr")

# First that fits names the kind of heading.
HEADING_PATTERNS = {
    "chapter": rf"(chapter|ch\.?)\s+([\divxlcdm]+|{NUMBER_WORDS})[\s.:—\-]*.*",
    "part": rf"(part|section|book)\s+([\divxlcdm]+|{NUMBER_WORDS})[\s.:—\-]*.*",
    "roman": r"[IVXLCDM]+\s*[.:—\-]\s*\S.*",
    "number": r"\d+[\s.:—\-]+\S.*",
    "named": rf"({NAMED_SECTIONS})[\s.:—\-]*.*",
}
CASELESS_HEADINGS = ("chapter", "part", "named")

# --- citations, links, reference lists and captions -------------------------------------------
CITATIONS = {
    "footnote": r"\[\d+(?:[,\-\s]\d+)*\]",
    "author_year": r"\([A-Z][a-z]+(?:\.?\s+(?:et\s+al\.?)?)?,?\s*\d{4}[^)]*\)",
    "et_al": r"\b[A-Z][a-z]+\s+et\s+al\.\s*\(\d{4}\)",
    "pages": r"\(pp?\.\s*\d+(?:\-\d+)?\)",
    "doi": r"doi:\s*[\d\.\w/\-]+",
    "url": r"http[s]?://[\w\.\-/\?\=&%]+",
    "www": r"www\.[\w\.\-/\?\=&%]+",
}
REFERENCE_HEADS = (r"references?", r"bibliography", r"(?:works?\s+)?cited")
REFERENCE_TAIL = r"\s*:?\s*\n(?!\s*$)(?:.{0,200}?\n){0,3}(?=(?:\n|$))"
REFERENCE_MARK = "\n[Reference section starts here]"
CAPTION = r"^\s*(?:figure|fig|table|tab)\s*\.?\s*\d+[\s.:\-].*"

# --- marker files ---------------------------------------------------------------------------
MARKER_HEADER = (
    ";FFMETADATA1\nmajor_brand=M4A\nminor_version=512\n"
    "compatible_brands=M4A isis2\nencoder=Lavf61.7.100\n"
)

# --- slug accents ---------------------------------------------------------------------------
ACCENTS = "àáâãäåèéêëìíîïòóôõöùúûüñç"
ACCENTS_PLAIN = "aaaaaaeeeeiiiiooooouuuunc"

# --- extensions -----------------------------------------------------------------------------
INPUT_EXTENSIONS = (".epub", ".pdf", ".txt", ".md")

# --- providers: (name, longest request, unit) -------------------------------------------------
PROVIDERS = (
    ("aws", 3000, "bytes"),
    ("google", 4800, "bytes"),
    ("kokoro", 5000, "chars"),
    ("openai", 4096, "chars"),
    ("qwen", 5000, "chars"),
)

# --- tasks: (name, requires a model, parameters) ----------------------------------------------
TASKS = (
    ("direct", False, {}),
    ("audiobook", True, {"temperature": 0.8, "top_p": 0.9, "repeat_penalty": 1.05,
                         "seed": 428798.0, "top_k": 60.0, "num_predict": 4096.0,
                         "num_ctx": 32768.0}),
    ("podcast", True, {"temperature": 0.9, "top_p": 0.95, "repeat_penalty": 1.05,
                       "num_predict": 4096.0, "num_ctx": 32768.0}),
    ("summary", True, {"temperature": 0.7, "top_p": 0.9, "num_predict": 4096.0,
                       "num_ctx": 32768.0}),
    ("meditation", True, {"temperature": 0.7, "top_p": 0.9, "num_predict": 4096.0,
                          "num_ctx": 32768.0}),
    ("lecture", True, {"temperature": 0.8, "top_p": 0.9, "num_predict": 4096.0,
                       "num_ctx": 32768.0}),
)

# --- languages ------------------------------------------------------------------------------
LANGUAGES = (
    ("en", "English"), ("es", "Spanish"), ("fr", "French"), ("de", "German"), ("it", "Italian"),
    ("pt", "Portuguese"), ("pl", "Polish"), ("tr", "Turkish"), ("ru", "Russian"),
    ("nl", "Dutch"), ("cs", "Czech"), ("ar", "Arabic"), ("zh", "Chinese"), ("hu", "Hungarian"),
    ("ko", "Korean"), ("ja", "Japanese"), ("hi", "Hindi"),
)

# --- judge request: the leading characters of source and script -------------------------------
JUDGE_SOURCE_CHARS = 8000
JUDGE_SCRIPT_CHARS = 4000
JUDGE_FORMAT = ("<source>\n", "\n</source>\n\n<script>\n", "\n</script>\n")

# --- how scripts that are really model errors begin or read -------------------------------------
ERROR_PREFIX = "Error: "
ERROR_MARKS = {
    "connection": "Could not connect",
    "timeout": "timed out",
    "api_key": "API key issue",
    "empty": "Unable to generate",
}

# --- messages -------------------------------------------------------------------------------
PROMPT_EMPTY = "Prompt cannot be empty."
PROMPT_SHORT = "Prompt is too short. Minimum 10 characters required."
PROMPT_OK = "Prompt is valid."
MIN_PROMPT_CHARS = 10
NO_LANGUAGE = "Language must be provided or detectable from the file metadata."
EMPTY_CHAPTER_SCRIPT = "This chapter contains no readable text content."
DURATION_CLASSES = {
    "much_shorter": "AUDIO MUCH SHORTER than expected based on source text. "
                    "Check for missing chapters.",
    "shorter": "AUDIO SHORTER than expected. Some chapters may be abbreviated.",
    "much_longer": "AUDIO MUCH LONGER than expected. Check for extra content or slow narration.",
    "longer": "AUDIO slightly longer than expected.",
    "as_expected": "AUDIO duration matches expectations based on source text length.",
}
