"""Fixed values.

These must equal the values the reference application uses, so that
results match it; they are stated here once, in plain text, and imported
where they are needed.
"""

# ---- fixed values (must equal the reference's) ----------------------------
NO_TITLE = "Brak tytułu"            # document title when a page has no h1
NO_TITLE_FILE = "brak_tytulu"       # text-file name when a page has no h1
DOC_TYPE = "ustawa"                 # doc_type of every document record
UNKNOWN_SOURCE = "Nieznane źródło"  # source label when a chunk has no parts
BM25_SOURCE = "BM25"                # source label of a BM25 hit without a title
NO_DOCUMENTS = "Brak dokumentów"    # answer when nothing was retrieved
ARTICLE_PREFIX = "art. "            # source label part for an article
PARAGRAPH_PREFIX = "§ "             # source label part for a paragraph
LABEL_JOINER = " - "                # joins the source label parts
H1_NOISE_TAG = "sup"                # removed inside the first h1
H1_NOISE_LINK_CLASS = "gloss-link tooltip"  # links with this class removed inside the first h1
UNSAFE_FILE_CHARS = '\\/*?:"<>|'    # each becomes "_" in a text-file name
FILE_NAME_CHARS = 50                # title-based file names are cut here
QUERY_NAME_CHARS = 20               # URL query part of a file name
RETRIEVAL_TOP_K = 50                # candidates per question
RERANK_TOP_K = 3                    # final chunks per question
MAX_CONTEXT_CHARS = 4000            # context budget (joiners not counted)
MAX_PAIR_TOKENS = 512               # rerank input truncation
FRAGMENT_FORMAT = "[{i}] {source} (score: {score})\n{content}\n"  # one context fragment
CONTEXT_JOINER = "\n"               # joins context fragments
HEADER_CHARS = 50                   # question characters in a log header, then "..."
REPORT_TEXT_CHARS = 100             # text preview in the document report
REPORT_TITLE_CHARS = 60             # title preview in the document report
