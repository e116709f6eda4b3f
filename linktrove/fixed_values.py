"""Fixed values.

Everything in this module is a value that has to be exactly as written for the
results to be right: labels, prefixes, patterns, phrase lists, size limits and
output formats.  No logic lives here.
"""

# --- labels, prefixes, texts --------------------------------------------------
CAPTURE_PROJECT = "capture"
NOT_SCRAPEABLE = "not-scrapeable"

EXTRACT_ERROR_PREFIX = "[Error:"
SUMMARY_ERROR_PREFIX = "Error generating summary:"
MODEL_CALL_ERROR = "Error calling LLM"

INSUFFICIENT_CONTENT_ERROR = "Pandoc extraction failed or insufficient content."
SEARCH_EMPTY_CONTENT = "[Error: Content extraction failed, and search fallback yielded no results]"
SEARCH_DISABLED_CONTENT = "[Error: Content extraction failed, search fallback disabled]"
TIMEOUT_EMPTY_CONTENT = "[Error: Page load timed out, and search fallback yielded no results]"
TIMEOUT_DISABLED_CONTENT = "[Error: Page load timed out, search fallback disabled]"
UNKNOWN_FAILURE_CONTENT = "[Error: Unknown processing failure - no content extracted]"

NOTE_NO_MEDIA = "[Note: No media files found to process]"
NOTE_NOTHING_STORED = "[Note: Media download/upload was attempted but no files were successfully processed]"
NO_TWEET_TEXT = "[No text content found]"
NO_ATTEMPT_CONTENT = "[No content extracted]"
NO_TRANSCRIPT = "Transcript: Not available"
NO_PLAYLIST_VIDEOS = "No videos found in playlist"
RETRIES_EXCEEDED = "Maximum retries exceeded"

PROMPT_HEADERS = {
    "webpage": "\nWEBPAGE CONTENT:\n",
    "pdf": "\nPDF CONTENT:\n",
    "github": "\nGITHUB REPO CONTENT:\n",
    "youtube": "\nTRANSCRIPTION CONTENT: \n",
}

REPORT_TITLE = "# Capture Report - "
EMPTY_REPORT = "No tasks with successfully scraped content were processed in this run."

# Words that number stored media in a report.
MEDIA_WORDS = ["Video", "Photo", "Audio", "Image"]

# Answers for texts that no model is asked about.
NO_TEXT_ANSWER = "No content to summarize."
NO_TRANSCRIPT_ANSWER = "No transcript content to summarize."

METHOD_PAGE = "pandoc_llm"
METHOD_SEARCH = "google_search"
METHOD_UNKNOWN = "unknown"
METHOD_TWEET = "playwright_bs4"
METHOD_VIDEO = "youtube_extractor"

# --- limits -------------------------------------------------------------------
PAGE_TEXT_LIMIT = 14000
TRANSCRIPT_TEXT_LIMIT = 25000
DESCRIPTION_LIMIT = 500
PLAYLIST_DESCRIPTION_LIMIT = 300
COMMENT_LIMIT = 100
MIN_CONTENT_CHARS = 50
TOP_COMMENTS = 5
PLAYLIST_PREVIEW = 10
PLAYLIST_PREVIEW_MAX = 50
PLAYLIST_SUMMARY_TITLES = 5
SUMMARY_WORDS = 200
SUMMARY_QUOTES = 3
TRANSCRIPT_ATTEMPTS = 3

# --- URL rules ----------------------------------------------------------------
TRACKER_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "mc_cid", "mc_eid", "si",
]

# "#" is not among the plain-text URL characters, so plain URLs lose fragments.
PLAIN_URL = r"(?U)https?://(?:[a-zA-Z0-9\-_./?=&%~+:@!$,]++|\(\S+\))+"
MARKDOWN_URL = r"\[[^\]]*\]\((https?://[^\)]+)\)"

TWEET_URL = r"^https?://(?:www\.)?(?:twitter\.com|x\.com)/[^/]+/status/[0-9]+"
TWEET_ID = r"(?:twitter\.com|x\.com)/[^/]+/status/([0-9]+)"
GITHUB_URL = r"^https?://github\.com/[^/]+/[^/]+"
VIDEO_URLS = [
    r"^https?://(?:www\.)?youtube\.com/watch\?.*v=[\w-]+",
    r"^https?://youtu\.be/[\w-]+",
    r"^https?://(?:www\.)?youtube\.com/embed/[\w-]+",
    r"^https?://(?:www\.)?youtube\.com/v/[\w-]+",
    r"^https?://m\.youtube\.com/watch\?.*v=[\w-]+",
    r"^https?://(?:www\.)?youtube\.com/playlist\?.*list=[\w-]+",
    r"^https?://m\.youtube\.com/playlist\?.*list=[\w-]+",
]
NOTEBOOK_URLS = [
    r"^https?://(?:www\.)?github\.com/.*\.ipynb",
    r"^https?://(?:www\.)?colab\.research\.google\.com/.*",
    r"^https?://(?:www\.)?kaggle\.com/.*(?:notebooks|code)",
    r"^https?://nbviewer\.jupyter\.org/.*\.ipynb",
    r"^https?://(?:www\.)?deepnote\.com/.*",
]
# A text without any of these words cannot hold a notebook URL.
NOTEBOOK_HINT = r"ipynb|colab\.research\.google|kaggle\.com|deepnote\.com"
VIDEO_HOSTS = ["www.youtube.com", "youtube.com"]
PLAYLIST_HOSTS = ["www.youtube.com", "youtube.com", "m.youtube.com"]

# --- media --------------------------------------------------------------------
MEDIA_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "mp4", "gif"]

# --- log noise ----------------------------------------------------------------
LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
LOGGER_MIN_LEVEL = {
    "urllib3": "WARNING",
    "pypandoc": "INFO",
    "playwright": "WARNING",
    "playwright.browser.console": "ERROR",
}
TEX_PHRASES = ["Could not convert TeX math", "rendering as TeX"]
EDITOR_PHRASES = [
    "monaco_editor", "vs/editor", "vs/css", "editor.main",
    "gstatic.com/colaboratory", "colab", "monaco",
    "modules that depend on it", "loading failed",
    "could not find", "vs/base/browser/ui",
    "actionbar", "browser/ui",
]
HTTP_OK = ["HTTP/1.1 200", "HTTP/1.1 201", "HTTP/1.1 204"]
HTTP_ERRORS = ["HTTP/1.1 4", "HTTP/1.1 5"]
API_POLL_PHRASES = ["api/show", "api/generate"]
SCRAPER_EDITOR_PHRASES = [
    "monaco", "vs/editor", "vs/css", "editor.main", "gstatic.com",
    "colaboratory", "could not find", "failed to load",
]
CONSOLE_ALWAYS_IGNORED = [
    "could not convert tex math", "rendering as tex", "monaco", "vs/css",
    "vs/editor", "failed to load resource", "cannot find", "could not find",
    "loading", "here are the modules", "actionbar", "colaboratory",
    "gstatic.com",
]
CONSOLE_ERROR_IGNORED = [
    "failed to load resource", "net::err_", "status of 403",
    "status of 404", "status of 429", "favicon.ico",
    "duplicate key", "devtools failed", "[tiktok]",
    "unrecognized feature", "sandbox attribute",
    "cannot read properties", "falha de execu", "user preferences",
    "web-share", "dependency", "browser", "widget", "javascript",
    "error loading", "cdn", "stylesheet", ".js", ".css",
    "codemirror", "editor", "static", "cdn failed", "404",
    "content security policy", "google analytics", "tracking",
    "ad blocker", "ui", "interface", "cors", "http request",
    "blocked by", "syntax error", "reference error", "null",
]
BROWSER_ERROR_IGNORED = [
    "monaco", "vs/editor", "vs/css", "editor.main",
    "gstatic.com", "colaboratory", "colab",
    "could not find", "failed to load",
    "modules that depend on it", "actionbar", "browser/ui",
    "contextview", "inputbox", "scrollbar",
]

# --- HTML entities decoded in page text ----------------------------------------
HTML_ENTITIES = {
    "&nbsp;": "\u00a0",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&copy;": "\u00a9",
    "&reg;": "\u00ae",
    "&middot;": "\u00b7",
    "&bull;": "\u2022",
    "&hellip;": "\u2026",
    "&ndash;": "\u2013",
    "&mdash;": "\u2014",
    "&lsquo;": "\u2018",
    "&rsquo;": "\u2019",
    "&ldquo;": "\u201c",
    "&rdquo;": "\u201d",
    "&amp;": "&",  # last, so that "&amp;lt;" stays "&lt;"
}
