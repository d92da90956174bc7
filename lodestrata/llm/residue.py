"""Problem 9: template residue, filler, error pages and demands for scripts that stand in place of content.

Lines of all documents are aligned. A line with something that may fill a slot (a variable, a default, a blank) asks for
the records of its template: lines of equal shape around the slot, filled ones included, copies of a line counted once.
Positions in which these records differ are slots. A variable in the syntax of a template language marks its slot by
itself; anything else is residue only if the alignment shows a slot there, which other records fill with something else.
Pages that repeat but for numbers and ids, and speak of an error, are templates of error pages as a whole; the fixed
messages below need no repetition where nothing but them is on a page.

Code blocks, inline code, quotations and quoted text explain or show such things and are taken out first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.slots import BITS, DEFAULT, FILLED, PAGE, VARIABLE, aligned_records, line_slots, page_of
from lodestrata.session import ensure_checkpoint_dir, spread

# Languages of files whose text is code.
CODE_LANGUAGES = frozenset("python javascript typescript java go golang php js ts jsx tsx py json yaml css shell sql xml".split())
CODE_ENDINGS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".php", ".json", ".yaml", ".yml", ".css", ".sh", ".sql", ".xml", ".vue")

FENCE = re.compile(r"^[ \t>]*(?:`{3,}|~{3,})")
INLINE = re.compile(r"`[^`\n]*`|\"[^\"\n]{2,200}\"|“[^”\n]{2,200}”|«[^»\n]{2,200}»|„[^“\n]{2,200}“")
# Syntax that only an unfilled template has.
CERTAIN = re.compile(
    r"\{\{\{?[^{}\n]*\}\}\}?|\$\{[^{}\n]+\}|<%[=\-]?[^%\n]+%>|\{%[^%\n]+%\}|\{\$[\w.>\[\]-]+\}|#\{[^{}\n]+\}|%[A-Z][A-Z_]{2,}%|%\(\w+\)[sd]"
    r"|\[\[[A-Z][A-Z _]*\]\]|\[(?:INSERT|YOUR|ENTER|ADD|INSERISCI|HIER)\b[^\]\n]*\]|\[(?:insert|your|enter) [^\]\n]+\]|<(?:YOUR|INSERT|ENTER|your|insert|enter)[ _-][^<>\n]+>"
    r"|(?<![\w_])__[A-Z][A-Z_]*?[A-Z]__(?![\w_])|@@\w+@@|##[A-Z_]+##|\bXX_[A-Z_]+_XX\b|\[object Object\]|\|[A-Z][A-Z_]+\|(?=[ ,.!])"
)
# Variables' names, defaults and blanks that prose may hold by itself.
DOUBTFUL = re.compile(
    r"(?<![\w{])\{(?:\d{1,2}|[a-z_]+(?:\.[a-z_]+)*)\}(?![\w}])|(?<![\w%])%(?:\d\$)?[sd@](?!\w)|\bundefined\b|\bnull\b|\bNaN\b|\bNone\b|\bN/A\b|\bJohn Doe\b|\bJane Doe\b"
    r"|\[[A-ZÇĞİÖŞÜ][\wçğıöşüÇĞİÖŞÜ]*(?: [\wçğıöşüÇĞİÖŞÜ]+){1,2}\](?![(\[:])|\[[a-z]+ (?:name|date|title|address|id|number)\](?![(\[:])|<[a-z]+(?: [a-z]+)+>|\b(?:Dear|Hello|Hi|Sayın|Sehr geehrte[rs]?|Estimad[oa]|by|to|on)\b[ \t]{1,3}(?=[,!.])"
)
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
FILLER = re.compile(
    r"(?i)^\W*(?:(?:your |insert |add |some )?(?:text|content|copy|description|paragraph|headline|title|body)(?: text)? (?:goes|comes|will go) here|(?:your|insert|add|enter) (?:\w+ )?(?:text|content|copy|description|title|headline) here|sample (?:text|paragraph|copy)\b.{0,40}|(?:buraya|burada) (?:\w+ )?metin.{0,20}|hier steht (?:\w+ )?(?:blind)?text|blindtext.{0,20}|(?:aquí|aqui) (?:va|irá) (?:el|su|tu)? ?(?:texto|contenido)|texto de (?:relleno|ejemplo).{0,20}|örnek metin.{0,20}|platzhaltertext.{0,20}|placeholder(?: text)?|dummy (?:text|content)|example (?:text|content)|lorem ipsum.{0,30}|coming soon|under construction|to be (?:written|completed|added|determined)|(?:asdf|qwerty|foo|blah|test|xxx)(?:[ ,]+(?:asdf|jkl|qwerty|bar|baz|foo|blah|test|xxx))+|t\.?b\.?d\.?|content pending)\W*$"
)
SLIDE = frozenset("title subtitle heading headline text caption section description content author date name name".split()) | {"bullet point", "click to add title", "click to add text", "your title", "sub title"}
SCRIPTS = re.compile(
    r"(?i)^\W*(?:noscript: [^.!?]*(?:[.!?]+[^.!?]*)?|(?:please |you (?:need|have|must) to? ?|kindly )?(?:enable|activate|turn on|allow|switch on|aktivieren sie|active|activa|habilite|etkinleştirin|activez)(?: sie)? (?:java ?)?scripts?[^.!?]*(?:[.!?]+[^.!?]*)?|(?:\S+ +){0,9}?(?:needs?|requires?|uses|depends on|relies on|benötigt|erfordert|requiere|gerektirir)\b (?:java ?)?scripts?\b[^.!?]*(?:[.!?]+[^.!?]*)?|bitte (?:aktivieren|erlauben|schalten) sie (?:java ?)?scripts?[^.!?]*(?:[.!?]+[^.!?]*)?|(?:\S+ +){0,9}?(?:java ?)?script(?:'i|leri|s|ing)?\b(?:\W+\w+){0,6}?\W+(?:etkinleştirin|açın|is disabled|are disabled|is required|are required|is off|deaktiviert|desactivado|switched off|turned off|must be (?:on|enabled|allowed)|enabled to)[^.!?]*(?:[.!?]+[^.!?]*)?|your browser (?:does not|doesn't) support (?:java ?)?scripts?[^.!?]*(?:[.!?]+[^.!?]*)?|(?:\S+ +){0,9}?without (?:java ?)?script(?:s|ing)?\W*|checking your browser[^.!?]*(?:[.!?]+[^.!?]*)?|(?:\S+ +){0,12}?scripts? and cookies must be[^.!?]*(?:[.!?]+[^.!?]*)?|you need to enable (?:java ?)?scripts?[^.!?]*(?:[.!?]+[^.!?]*)?)\W*$"
)
ERROR = re.compile(
    r"(?i)^\W*(?:(?:error|http|fehler|hata|status)?[ :]*[45]\d\d\b[^.!?]*(?:[.!?]+[^.!?]*)?|(?:\w+ )?(?:page|site|file|seite|sayfa|página|resource|url|document)\b(?:\W+\w+){0,5}?\W+(?:not found|nicht gefunden|bulunamadı|no encontrad[ao]|could not be (?:found|located)|is gone|does not exist|existiert nicht|no existe|unavailable|expired)|(?:the )?requested (?:\w+ )?(?:resource|page|url|document|file)\b[^.!?]*(?:[.!?]+[^.!?]*)?|(?:\S+ +){0,4}?could not be (?:located|found|loaded|reached|displayed)\b[^.!?]*(?:[.!?]+[^.!?]*)?|access (?:is |was )?denied[^.!?]*(?:[.!?]+[^.!?]*)?|(?:zugriff|acceso|erişim)\W? (?:verweigert|denegado|engellendi|reddedildi)|permission denied|forbidden|unauthorized|(?:\S+ +){0,4}?something went wrong[^.!?]*(?:[.!?]+[^.!?]*)?|(?:an )?(?:unexpected |internal |unknown )?(?:server )?error(?: has)? occurred[^.!?]*(?:[.!?]+[^.!?]*)?|internal server error|bad (?:gateway|request)|gateway time-?out|(?:the )?(?:request|connection|upstream|session)\b(?:\W+\w+){0,3}?\W+(?:timed out|has expired|expired|was reset|refused)[^.!?]*(?:[.!?]+[^.!?]*)?|\w+ expired\W+please log in[^.!?]*(?:[.!?]+[^.!?]*)?|too many requests[^.!?]*(?:[.!?]+[^.!?]*)?|rate limit exceeded[^.!?]*(?:[.!?]+[^.!?]*)?|service (?:temporarily )?unavailable|(?:this|the) (?:\w+ )?(?:repository|account|page|site|project|channel|video|content|user|organisation|organization)\b(?:\W+\w+){0,3}?\W+(?:has been|was|is|are) (?:disabled|suspended|removed|deleted|blocked|down|unavailable|no longer available|not available)[^.!?]*(?:[.!?]+[^.!?]*)?|(?:we are )?(?:down for|under) maintenance[^.!?]*(?:[.!?]+[^.!?]*)?|sayfa bulunamadı|seite nicht gefunden|página no encontrada|page introuvable|not found|etwas ist schiefgelaufen[^.!?]*(?:[.!?]+[^.!?]*)?|bir (?:şeyler ters gitti|hata oluştu)[^.!?]*(?:[.!?]+[^.!?]*)?|algo salió mal[^.!?]*(?:[.!?]+[^.!?]*)?|are you (?:a )?(?:human|robot)[^.!?]*(?:[.!?]+[^.!?]*)?|verify (?:that )?you are (?:a )?human[^.!?]*(?:[.!?]+[^.!?]*)?|(?:php )?(?:fatal|parse) error\b.*|uncaught \w*(?:error|exception)\b.*|traceback \(most recent call last\)[^.!?]*(?:[.!?]+[^.!?]*)?|unhandled exception.*|thrown in \S+ on line \d+)\W*$"
)
JSON_WORDS = re.compile(r"(?i)\"(?:errors?|fault|exception)\"\s*:\s*+(?!null|\[\s*\]|\"\"|false)|\"(?:status|code|statusCode)\"\s*:\s*\"?[45]\d\d|\"(?:status|success|ok)\"\s*:\s*(?:\"(?:error|fail)|false)")
TAG = re.compile(r"<(?:!--.*?--|/?[a-zA-Z!][^<>]*)>", re.S)
HTML = re.compile(r"(?i)<(?:!doctype|html|head|body|title|center|noscript|script|div|h1|p|meta)\b")
TRACE = re.compile(r"(?m)^\s*(?:#\d+ \S|at [\w$.]+\(|File \"|thrown in |Stack trace|Stack \w+:)")
WORD = re.compile(r"[^\W\d_]+")
AGREEMENT = 0.6  # share of the tokens around a slot that most records of a template have
PAGE_START = re.compile(r"(?i)\s*(?:<!doctype|<html|\{\s*\"(?:error|status|message)\")")
CONTENT = 40  # words that an error page may hold beside its message: navigation, a search field, a footer


LINE_END = re.compile(rb"\r\n|\n|\r|\xe2\x80\xa8")


def failed_request(whole: str) -> bool:
    """Whether a text is the JSON answer to a request that failed."""
    if whole[:1] != "{":
        return False
    try:
        answer = json.loads(whole)
    except (ValueError, RecursionError):  # cut off or not quite JSON: its first object
        return bool(JSON_WORDS.search(whole.partition("}")[0]))
    top = json.dumps({k: v if isinstance(v, (str, int, float, bool, type(None))) else [0] if v else [] for k, v in answer.items()}, ensure_ascii=False)
    return bool(JSON_WORDS.search(top))


# What a line must hold for one of the grammars to accept it; a test holds these against the grammars.
MARKS = (b"{", b"%", b"[", b"<", b"|", b"__", b"@@", b"##", b"XX_", b"undefined", b"null", b"NaN", b"None", b"N/A", b"Doe")
BLANK = re.compile(rb"[ \t][,!.]")
ERROR_KEYS = frozenset("found gefunden bulunamadı bulunamadi encontrado encontrada located gone exist existiert existe unavailable expired requested could denied verweigert denegado engellendi reddedildi forbidden unauthorized wrong error bad gateway timed reset refused requests rate disabled suspended removed deleted blocked down longer available maintenance introuvable schiefgelaufen ters hata algo human uncaught traceback unhandled thrown robot time".encode().split())
FILLER_KEYS = frozenset("here text steht sample metin blindtext platzhaltertext texto contenido placeholder dummy example lorem soon construction written completed added determined asdf qwerty foo blah test xxx tbd t pending".encode().split())
SLIDE_KEYS = frozenset(w.encode() for x in SLIDE for w in x.split()) | {b"bullet", b"section"}
LOREM_KEYS = frozenset(w.encode() for w in LOREM)
STATUS = re.compile(rb"(?:[\W_]|\d+[.)]\s)*(?:error|http|fehler|hata|status)?[ :]*[45]\d\d(?!\d)", re.I)
TO_WORDS = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in bytes(range(256)).lower())


def lines_of(data: bytes) -> Iterator[bytes]:
    """The lines of a text that are neither blank nor shown as code or quotation."""
    fence, start = False, 0
    ends = [(m.start(), m.end()) for m in LINE_END.finditer(data)] + [(len(data), len(data))]
    for stop, following in ends:
        raw = data[start:stop]
        start = following
        lead = raw.lstrip()
        first = lead[:1]
        if lead[:3] in (b"```", b"~~~") or first == b">" and FENCE.match(raw.decode("utf-8", "replace")):
            fence = not fence
        elif not (fence or first in (b">", b"") or raw[:4] == b"    " or raw[:1] == b"\t"):
            yield raw


def visible(raw: bytes) -> str:
    return INLINE.sub(" ", raw.decode("utf-8", "replace")).strip("\u200b\ufeff \t")


def content_of(line: str) -> str:
    bare = TAG.sub(" ", line).strip() if "<" in line else line
    return re.sub(r"^(?:#{1,6}|[-*+]|\d+[.)])\s+", "", bare).strip(" *_")


def marks_in(data: bytes) -> list[bytes]:
    """What of MARKS a text holds, so that its lines are asked for nothing else; a blank before a sign is asked for by itself."""
    return [x for x in MARKS if x in data] + ([BLANK] if BLANK.search(data) else [])


def fillings(raw: bytes, marks: list) -> tuple[str, list[tuple[int, int, bool]]]:
    """(line, places of what may fill a slot: start, end, whether by its syntax alone)."""
    for x in marks:
        if (BLANK.search(raw) if x is BLANK else x in raw and (x != b"##" or x in raw.lstrip(b"#"))):
            break
    else:
        return "", []
    line = visible(raw)
    found = [(m.start(), m.end(), True) for m in CERTAIN.finditer(line)]
    found += [(m.start(), m.end(), False) for m in DOUBTFUL.finditer(line) if not any(s <= m.start() < e for s, e, _ in found)]
    return line, sorted(found)


def plain_lines(data: bytes) -> Iterator[bytes]:
    marks = marks_in(data)
    return (raw for raw in lines_of(data) if not marks or not fillings(raw, marks)[1])


def judge(data: bytes) -> tuple[str | None, list[tuple], list[bytes]]:
    """(kind if the text alone decides, slots of its lines as `line_slots` gives them, its other lines); every line is read."""
    if data.lstrip(b"\xef\xbb\xbf\xe2\x80\x8b \t\r\n")[:1] == b"{" and failed_request(data.decode("utf-8", "replace").strip("\ufeff\u200b \t\r\n")):
        return "error page", [], []
    slots: list[tuple] = []
    other: list[bytes] = []
    kind = None
    slides = fillers = kept = 0
    error_at = -1  # how many other lines stand before the first message
    marks = marks_in(data)
    for raw in lines_of(data):
        kept += 1
        line, found = fillings(raw, marks) if marks else ("", [])
        if found:
            slots += line_slots(line, found)
            if any(certain for _, _, certain in found):
                kind = kind or "placeholder"
        if kind:
            continue
        own = set(raw.translate(TO_WORDS).split())
        low = raw.lower()
        script, few = b"cript" in low or b"checking your" in low, len(own) <= 6
        error = not own.isdisjoint(ERROR_KEYS) or bool(STATUS.match(raw)) or b"<" in raw
        if not (few or script or error or not own.isdisjoint(FILLER_KEYS) or len(own & LOREM_KEYS) >= 2):
            other.append(raw)
            continue
        bare = content_of(line or visible(raw))
        if not bare:
            continue
        if few and not own.isdisjoint(SLIDE_KEYS) and slide(bare):
            slides += 1
        elif script and SCRIPTS.match(bare):
            kind = "script notice"
        elif len(own & LOREM_KEYS) >= 2 and lorem(bare) or few and repeated(bare):
            kind = "filler"
        elif not own.isdisjoint(FILLER_KEYS) and FILLER.match(bare):
            fillers += 1
        elif error and ERROR.match(bare):
            error_at = len(other) if error_at < 0 else error_at
        else:
            other.append(raw)
    if not kind and (slides >= 2 and slides * 2 >= kept or fillers):
        kind = "filler"
    if not kind and error_at >= 0:
        texts = (content_of(visible(x)) for x in other)
        words = sum(len(WORD.findall(x)) for i, x in enumerate(texts) if not (i >= error_at and "|" in x) and not TRACE.match(x))
        kind = "error page" if words <= CONTENT else None
    return kind, slots, other


def lorem(line: str) -> bool:
    own = WORD.findall(line.lower())
    return len(own) >= 4 and sum(w in LOREM for w in own) >= 0.6 * len(own)


def slide(line: str) -> bool:
    low = line.lower().rstrip(".:!")
    return low in SLIDE or bool(re.fullmatch(r"(?:bullet point|section|title|text) \d+", low))


SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def repeated(line: str) -> bool:
    """A line that is one short sentence or one word over and over."""
    own = line.lower().split()
    if len(own) < 2 or len(own) == len(set(own)):
        return False
    if len(own) >= 4 and len(set(own)) == 1 and len(own[0]) > 2 and own[0].isalpha():
        return True
    said = [s.strip().lower().rstrip(".") for s in SENTENCE_END.split(line) if s.strip()]
    return len(said) > 1 and len(set(said)) == 1 and 1 < len(said[0].split()) <= 6


def is_code(language: str | None, path: str | None, text: str) -> bool:
    low = (language or "").lower()
    if low in ("markdown", "text", "html"):
        return False
    if low in CODE_LANGUAGES or not low and (path or "").lower().endswith(CODE_ENDINGS):
        return not PAGE_START.match(text)
    return False


VERDICT = "kind string, key long, value long, state int, record long, tokens array<bigint>"
VERDICT_ARROW = [("kind", pa.string()), ("key", pa.int64()), ("value", pa.int64()), ("state", pa.int32()), ("record", pa.int64()), ("tokens", pa.list_(pa.int64()))]


def verdicts(documents: DataFrame) -> DataFrame:
    """doc_id and either a kind that the text alone decides, or a slot of one of its lines, or (state PAGE) its template as a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, out = [], []
            for doc, language, path, text in zip(*(c.to_pylist() for c in b.columns)):
                if is_code(language, path, text):
                    continue
                kind, slots, other = judge(text.encode("utf-8", "replace"))
                rows = [(None, *slot) for slot in slots]
                if kind:
                    rows.append((kind, None, None, None, None, None))
                elif page := page_of(other):
                    rows.append((None, *page))
                docs += [doc] * len(rows)
                out += rows
            cols = list(zip(*out)) if out else [[]] * len(VERDICT_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.column(0).type), *(pa.array(c, t) for c, (_, t) in zip(cols, VERDICT_ARROW))], names=["doc_id", *(n for n, _ in VERDICT_ARROW)])

    return spread(texts(documents)).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, {VERDICT}")


def texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "language", "file_path", "text").where(F.length("text") > 0)


def filled_records(documents: DataFrame, asked: bytes) -> DataFrame:
    """key, value, state, record, tokens of the lines without residue whose shape is among the asked ones.

    `asked` is a bitmap of fixed size over hashes of shapes: a hit may be false, a miss never is.
    """
    bits = np.frombuffer(asked, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines: dict[bytes, None] = {}
            for _, language, path, text in zip(*(c.to_pylist() for c in b.columns)):
                if not is_code(language, path, text):
                    lines.update(dict.fromkeys(plain_lines(text.encode("utf-8", "replace"))))
            rows = aligned_records(list(lines), bits)
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, VERDICT_ARROW[1:])], names=[n for n, _ in VERDICT_ARROW[1:]])

    return spread(texts(documents)).mapInArrow(run, VERDICT.partition(", ")[2])


def induced(records: DataFrame) -> DataFrame:
    """key, value of the slots that alignment shows, once for each value that may be residue in them.

    Records of a key are lines of equal shape around the slot, each once. They are of one template if AGREEMENT of their
    other tokens are ones that most of them have; the rest are further slots. A variable in the slot is residue if another
    record has another variable, a default or a blank there, a default or blank if another has a variable; either if
    others have two different fillings.
    """
    size = records.groupBy("key").agg(F.count("*").alias("n"))
    tokens = records.select("key", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("key", "token").agg(F.count("*").alias("held"))
    agree = tokens.join(size.where("n > 1"), "key").groupBy("key").agg(F.sum(F.when(F.col("held") * 2 > F.col("n"), F.col("held")).otherwise(0)).alias("same"), F.sum("held").alias("all"))
    agree = agree.where(F.col("same") >= AGREEMENT * F.col("all")).select("key")
    values = records.groupBy("key", "value").agg(F.min("state").alias("state")).join(agree, "key", "left_semi")
    kinds = values.groupBy("key").agg(F.count(F.when(F.col("state") <= VARIABLE, 1)).alias("variables"), F.count(F.when(F.col("state") == DEFAULT, 1)).alias("defaults"), F.count(F.when(F.col("state") == FILLED, 1)).alias("fills"))
    own = values.where(F.col("state").isin(VARIABLE, DEFAULT)).join(kinds, "key")
    others = F.col("variables") + F.when(F.col("state") == VARIABLE, F.col("defaults") - 1).otherwise(0)
    return own.where((others >= 1) | (F.col("fills") >= 2)).select("key", "value")


def residue(documents: DataFrame, least_pages: int = 3) -> DataFrame:
    """(doc_id, kind): each document that carries residue in place of content, once.

    A variable, default or blank that prose may hold by itself counts if the alignment of all documents shows a slot
    there (see `induced`). A page counts as an error page if
    at least `least_pages` different texts are the same but for numbers and ids. Copies of a line or text are one record
    and are judged alike. Null, empty and blank texts have no case. An empty table gives an empty result; other columns
    are ignored.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    seen = verdicts(documents).checkpoint()  # a few rows
    certain = seen.where("kind is not null").select("doc_id", "kind")
    slots = seen.where("kind is null and tokens is not null")
    open_ = slots.where(F.col("state").isin(VARIABLE, DEFAULT)).join(certain.select("doc_id"), "doc_id", "left_anti")
    # shapes that are asked for, as a bitmap of BITS bits: at most BITS / 64 rows, however many documents there are
    at = F.pmod("key", F.lit(BITS))
    words = open_.select(F.floor(at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {BITS}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    records = slots.select("key", "value", "state", "record", "tokens")
    if len(words):
        records = records.unionByName(filled_records(documents, bits.tobytes()))
    asked = open_.select("key").distinct()
    shown = induced(records.join(asked, "key", "left_semi").dropDuplicates(["key", "record"]).checkpoint())  # read by several aggregations
    doubtful = open_.join(shown, ["key", "value"], "left_semi").select("doc_id", F.lit("placeholder").alias("kind"))

    pages = seen.where(F.col("state") == PAGE)
    repeated_pages = pages.groupBy("key", "record").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    errors = pages.join(repeated_pages, "key", "left_semi").select("doc_id", F.lit("error page").alias("kind"))
    return certain.unionByName(doubtful).unionByName(errors).dropDuplicates(["doc_id"])


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that carry no residue, with all their columns; rows with a null doc_id are kept."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")
