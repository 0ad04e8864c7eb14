"""Fixed values.

Everything in this module is a value that decides a result (word lists, markers,
lookup tables, thresholds, patterns of a publisher's format).  Nothing here is logic.
"""

# ---------------------------------------------------------------- sources
SEED_SOURCE = "openlibrary"
SOURCE_ORDER = ["openlibrary", "goodreads", "amazon", "bookbub", "kobo", "audible"]
RECORD_FIELDS = ["title", "authors", "publisher", "origin", "date_of_publication",
                 "language", "genres"]
ARTEFACT_INFIX = {"covers": "cp", "blurb": "b", "reviews": "r", "genres": "g"}

# ---------------------------------------------------------------- identifier lists
LIST_DELIMITERS = ",;\t|"
ISBN_HEADER_GROUPS = [["isbn13", "ean13"], ["isbn", "isbns"], ["isbn10"],
                      ["ean", "barcode", "gtin", "gtin13"]]
LABEL_HEADERS = ["title", "booktitle", "name", "book", "bookname"]
ISBN_LABEL_PATTERN = r"(?i)^\s*e?isbn(?:[\s\-_]*1[03])?\s*[:=]?\s*"
ISBN_NOISE_PATTERN = "[\\s \\-‐‑‒–—―−_]+"

# ---------------------------------------------------------------- titles
SUBTITLE_PATTERN = r"\s*(?::|;|\s[-–—]\s|\(|\[)\s*"
ORDINALS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5",
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6",
    "1": "1", "2": "2", "3": "3", "4": "4", "5": "5",
    "6": "6", "7": "7", "8": "8", "9": "9", "10": "10",
}
# already folded (lower case, punctuation to spaces)
DERIVATIVE_MARKERS = [
    "study guide", "studyguide", "summary of", "summary and analysis", "a summary",
    "summaries", "analysis of", "conversation starters", "trivia on books",
    "digest review", "digest and review", "workbook",
    "quicklet", "cliffs notes", "cliffsnotes", "sparknotes", "joosr", "instaread",
    "book club kit", "book club questions", "book club", "a guide to",
    "key takeaways", "reading guide", "review and analysis", "shortcut",
    "boxed set", "box set", "books collection",
]

# ---------------------------------------------------------------- match thresholds
CONTAINED_SCORE = 0.85
AUTHOR_RATIO = 0.72
BEST_FLOOR = 0.85
GOODREADS_FLOOR, GOODREADS_KEEP = 0.80, 3
KOBO_FLOOR = 0.86
AUDIBLE_FLOOR, AUDIBLE_SIBLING = 0.85, 0.995
AUDIBLE_EDITION_PATTERN = (r"(?i)[\(\[]|\b(?:edition|unabridged|abridged|version|translat\w*|"
                           r"reissue|anniversary|deluxe)\b")
AMAZON_FUZZY, AMAZON_OPENED = 0.72, 3
BOOKBUB_STRONG, BOOKBUB_ACCEPT, BOOKBUB_CONFIDENT = 0.95, 0.60, 0.90
BOOKBUB_ADDITIVE, BOOKBUB_SLUGS, BOOKBUB_AUTHOR_ROWS, BOOKBUB_PAGES = 0.80, 3, 2, 5

# ---------------------------------------------------------------- languages
LANGUAGE_NAMES = {
    "en": "English", "eng": "English",
    "fr": "French", "fre": "French", "fra": "French",
    "de": "German", "ger": "German", "deu": "German",
    "es": "Spanish", "spa": "Spanish",
    "it": "Italian", "ita": "Italian",
    "nl": "Dutch", "dut": "Dutch", "nld": "Dutch",
    "pt": "Portuguese", "por": "Portuguese",
    "ru": "Russian", "rus": "Russian",
    "ja": "Japanese", "jpn": "Japanese",
    "zh": "Chinese", "chi": "Chinese", "zho": "Chinese",
    "ko": "Korean", "kor": "Korean",
    "ar": "Arabic", "ara": "Arabic",
    "hi": "Hindi", "hin": "Hindi",
    "he": "Hebrew", "heb": "Hebrew",
    "el": "Greek", "gre": "Greek", "ell": "Greek",
    "sv": "Swedish", "swe": "Swedish",
    "da": "Danish", "dan": "Danish",
    "no": "Norwegian", "nb": "Norwegian", "nor": "Norwegian",
    "fi": "Finnish", "fin": "Finnish",
    "pl": "Polish", "pol": "Polish",
    "cs": "Czech", "cze": "Czech", "ces": "Czech",
    "tr": "Turkish", "tur": "Turkish",
    "hu": "Hungarian", "hun": "Hungarian",
    "ro": "Romanian", "rum": "Romanian", "ron": "Romanian",
    "uk": "Ukrainian", "ukr": "Ukrainian",
    "ca": "Catalan", "cat": "Catalan",
    "id": "Indonesian", "ind": "Indonesian",
    "th": "Thai", "tha": "Thai",
    "vi": "Vietnamese", "vie": "Vietnamese",
}
CATALOGUE_LANGUAGES = {
    "eng": "English", "spa": "Spanish", "fre": "French", "fra": "French",
    "ger": "German", "deu": "German", "ita": "Italian", "por": "Portuguese",
    "rus": "Russian", "jpn": "Japanese", "chi": "Chinese", "zho": "Chinese",
    "ara": "Arabic", "hin": "Hindi", "dut": "Dutch", "nld": "Dutch",
}

# ---------------------------------------------------------------- dates
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
PACIFIC = "America/Los_Angeles"

# ---------------------------------------------------------------- images
PLACEHOLDER_WORDS = ["no-cover", "nophoto", "no_cover", "blank.g", "placeholder"]
MIN_COVER_BYTES = 512
COVER_CAP, AMAZON_COVER_CAP = 6, 12
IMAGE_MAGIC = [("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"),
               ("474946383961", "gif"), ("424D", "bmp"), ("49492A00", "tiff"),
               ("4D4D002A", "tiff")]
IMAGE_CONTENT_TYPES = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/pjpeg": "jpg", "image/png": "png",
    "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/bmp": "bmp",
    "image/tiff": "tiff", "image/svg+xml": "svg",
}
PRINT_FORMATS = {"HARDCOVER": 0, "PAPERBACK": 1, "MASS_PAPERBACK": 2, "BOARD_BOOK": 5,
                 "LIBRARY_BINDING": 5, "SPIRAL_BOUND": 5, "LEATHER_BOUND": 5}
SIBLING_EDITIONS = 2

# ---------------------------------------------------------------- walls
WALL_HARD = [
    "enter the characters you see below", "type the characters you see in this image",
    "/errors/validatecaptcha", "captcha-delivery.com", "g-recaptcha", "h-captcha",
    "hcaptcha.com", "cf-browser-verification", "checking if the site connection is secure",
    "attention required! | cloudflare", "request unsuccessful. incapsula", "px-captcha",
    "perimeterx", "awswafcookiedomainlist", "awswafintegration", "token.awswaf.com",
    "we need to verify that you're not a robot",
]
WALL_SOFT = ["robot check", "are you a robot", "just a moment...", "pardon our interruption",
             "unusual traffic from your computer", "access denied", "you have been blocked"]
WALL_HEAD_CHARS, WALL_SMALL_BODY = 8192, 20480
# (source, class, scope in characters or null for the whole page, longest page or null, pattern)
PAGE_CLASS_RULES = [
    ("amazon", "notfound", 8192, None, r"(?i)<title[^>]*>\s*Page Not Found"),
    ("amazon", "signin", None, None,
     r"(?i)<title[^>]*>\s*Amazon Sign-?In|id=\"ap_email|id=\"ap_login_form"),
    ("amazon", "interstitial", 8192, 4999,
     r"(?i)bm-verify|/_sec/verify\?provider=interstitial|triggerinterstitialchallenge"
     r"|m\.media-amazon\.com/images/s/sash/"),
    ("kobo", "challenge", 8192, None,
     r"(?i)challenged \| kobo\.com|enable javascript and cookies to continue"),
    ("bookbub", "challenge", 20000, None,
     r"(?i)just a moment\.\.\.|window\._cf_chl_opt|__cf_chl_tk|challenges\.cloudflare\.com"
     r"|/cdn-cgi/challenge-platform/|enable javascript and cookies to continue"),
    ("bookbub", "notfound", None, None,
     r"(?is)<(?:title|h1)\b[^>]*>[^<]*page (?:not found|doesn't exist|does not exist)"),
    # the marker that the throttle page of this shop carries near its top
    ("audible", "throttle", 4096, None, r"crackedegg\.jpg"),
]

# ---------------------------------------------------------------- hosts
HOST_LIMITS = [("openlibrary.org", 2.5, 4.0, 30), ("covers.openlibrary.org", 3.5, 5.0, 45),
               ("archive.org", 3.5, 5.0, 60)]
STRIKES_BEFORE_PAUSE, PAUSE_SECONDS, PAUSE_STEPS = 3, 30, 4

# ---------------------------------------------------------------- origin
ORIGIN_KEYS = ["placeofpublication", "publicationplace", "publishplace", "publishplaces",
               "placepublished", "countryoforigin", "publicationcountry", "publishcountry",
               "countryregionoforigin", "publishedin"]
PLACE_NAME_KEYS = ["name", "@value", "value", "text", "addressCountry", "addressLocality"]

# ---------------------------------------------------------------- markup
BLOCK_TAGS = ["p", "div", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5",
              "h6", "blockquote"]
JSONLD_WRAPPERS = ["@graph", "mainEntity", "mainEntityOfPage", "itemListElement"]

# ---------------------------------------------------------------- per shop
BOOKBUB_PUBLISHER_LABELS = ["publisher", "published by", "imprint"]
BOOKBUB_ORIGIN_LABELS = ["country", "country of origin", "place of publication",
                         "published in", "origin"]
BOOKBUB_DATE_LABELS = ["publication date", "published", "publish date", "release date",
                       "first published", "pub date", "on sale date"]
BOOKBUB_LANGUAGE_META = ["books:language", "book:language", "inLanguage", "og:book:language",
                         "language"]
MARKETING_TAG_PATTERN = (r"(?i)bestselling author|authors and books|^noteworthy$|\b(?:new york times"
                         r"|usa today|wall street journal|sunday times|publishers weekly"
                         r"|amazon charts)\b")
AMAZON_DROP_CRUMBS = ["books", "kindle store", "audible books & originals"]
KOBO_DROP_CRUMBS = ["kobo books", "home", "ebooks", "audiobooks", "books"]
AUDIBLE_CHIP_KINDS = ["genre", "theme", "category", "goodreads"]
AUDIBLE_COVER_JUNK = ["_CLa", "PJAdblSocialShare", "AudibleLogo"]
BOOKBUB_NON_BOOKS = ["index", "search", "new-releases", "deals"]
KOBO_COVER_URL = "https://cdn.kobo.com/book-images/{}/1200/1200/100/False/cover.jpg"
MIN_REVIEW_CHARS = {"openlibrary": 1, "goodreads": 20, "amazon": 2, "bookbub": 1, "kobo": 2,
                    "audible": 2}
