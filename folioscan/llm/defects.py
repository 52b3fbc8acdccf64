"""Broken prompt and response pairs: empty, truncated, refusal, echo, wrong_language.

Copies of the prompt are found by compressing the answer with its prompt as a zstandard dictionary, and the
prompt with the answer: an echo costs next to nothing either way. Refusals and languages are judged with dictionaries. Whether an answer
breaks off is judged by a model of terminal contexts: how often answers that ended normally end in the
answer's last two kinds of characters, against how often these stand anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.canonical import INVISIBLE, flatten, normalise

DEFECTS = ("empty", "truncated", "refusal", "echo", "wrong_language")
# What providers call their length limit.
LENGTH_STOPS = ("max_tokens", "length", "model_length", "max_output_tokens", "token_limit", "model_context_window_exceeded")
# Answers that stand for no answer.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "nan", "undefined", "tbd", "todo", "tba", "no answer", "answer here", "your answer here", "placeholder", "empty", "unknown", "lorem ipsum", "គ្មាន", "មិនមាន")
# Labels that announce content.
LABELS = r"(?:final\s+answer|answer|solution|step\s*\d+|result|response|explanation|note|output|ចម្លើយ|ដំណោះស្រាយ|លទ្ធផល|ការពន្យល់|ជំហានទី\s*[0-9០-៩]+|ជំហាន\s*[0-9០-៩]*)"
# What an echo may be announced with.
ASKED = r"^(?:>\s*|(?:you\s+asked|you\s+said|question|prompt|the\s+question\s+(?:is|was)|your\s+question|user|q|អ្នកបានសួរ|សំណួរ|សំណួររបស់អ្នក)\s*[:៖]\s*)+"
# Declining phrases.
REFUSALS = re.compile(
    r"(?:can\s?not|can't|unable\s+to|not\s+able\s+to|won't\s+be\s+able\s+to|not\s+allowed\s+to|not\s+permitted\s+to|not\s+going\s+to)\s+(?:be\s+)?(?:help|assist|answer|provide|discuss|comply|fulfil|complete\s+th|respond|do\s+that|work\s+on|process|support|offer|share)"
    r"|(?:must|have\s+to|need\s+to|will)\s+(?:respectfully\s+)?(?:decline|refuse)|i\s+(?:decline|refuse)\s+to"
    r"|not\s+be\s+appropriate\s+for\s+me|against\s+my\s+(?:guidelines|policy|policies)|guidelines\s+(?:do\s+not|don't|prevent)"
    r"|won't\s+be\s+giving|will\s+not\s+be\s+giving|can't\s+be\s+processed|cannot\s+be\s+processed|request\s+(?:is|was)\s+(?:not\s+allowed|blocked|denied)"
    r"|មិនអាច(?:ជួយ|ឆ្លើយ|ផ្តល់|ដោះស្រាយសំណួរ|បំពេញ)|បដិសេធ|មិនត្រូវបានអនុញ្ញាត|មិនអនុញ្ញាតឱ្យខ្ញុំ|ហាមឃាត់",
    re.I,
)
# Sentences that go with a refusal.
COURTESY = re.compile(r"sorry|apolog|unfortunately|thank\s+you|please\s+(?:ask|try)|try\s+another|ask\s+your|as\s+an?\s+\w+\s+(?:assistant|model)|សុំទោស|អភ័យទោស|អកុសល|សូមសួរ|សូមអភ័យ", re.I)
# Frequent words of languages in Latin letters.
COMMON = {
    "en": set("the of and to in is that for it with as this each every one some another its our we a an by then therefore while whenever since".split()),
    "fr": set("le la les des une est dans pour que qui avec sur cette donc nous du au et par plus pas sont".split()),
    "de": set("der die das und ist nicht mit ein eine für auf dem den des von wir sich auch durch werden".split()),
    "es": set("el los las una es en que para con por esta este donde como del al más son se lo".split()),
    "vi": set("của và là các một trong được với cho không này có những khi".split()),
}
SCRIPTS = {"km": re.compile("[ក-៓]"), "zh": re.compile("[㐀-鿿]"), "hi": re.compile("[ऀ-ॿ]"), "th": re.compile("[฀-๿]"), "la": re.compile("[A-Za-zÀ-ɏ]"), "ru": re.compile("[Ѐ-ӿ]"), "ar": re.compile("[؀-ۿ]"), "ja": re.compile("[぀-ヿ]"), "ko": re.compile("[가-힣]")}
# How prompts name the language they want.
ASKS = {
    "en": re.compile(r"(?:in|into|using)\s+english|ភាសាអង់គ្លេស", re.I),
    "km": re.compile(r"(?:in|into|using)\s+khmer|ភាសាខ្មែរ", re.I),
    "zh": re.compile(r"(?:in|into|using)\s+chinese|ភាសាចិន|中文", re.I),
    "hi": re.compile(r"(?:in|into|using)\s+hindi|ភាសាហិណ្ឌី|हिन्दी", re.I),
    "fr": re.compile(r"(?:in|into|using)\s+french|ភាសាបារាំង", re.I),
    "de": re.compile(r"(?:in|into|using)\s+german|ភាសាអាល្លឺម៉ង់", re.I),
    "es": re.compile(r"(?:in|into|using)\s+spanish|ភាសាអេស្ប៉ាញ", re.I),
    "vi": re.compile(r"(?:in|into|using)\s+vietnamese|ភាសាវៀតណាម", re.I),
}
FORMULA = re.compile(r"(?=[$\\`])(?:\$\$.*?(?:\$\$|\Z)|\$[^$\n]*(?:\$|\Z)|\\\[.*?(?:\\\]|\Z)|\\\(.*?(?:\\\)|\Z)|```.*?(?:```|\Z)|`[^`\n]*`)", re.S)
LABEL = re.compile(rf"{LABELS}\s*\*{{0,2}}\s*[:៖]\s*\*{{0,2}}", re.I)
#: Words that labels and placeholders consist of: any other word is content.
FRAME = frozenset(re.findall(r"[a-z]+|[ក-៓]+", LABELS.lower().replace(r"\s", " ").replace(r"\d", " ") + " " + " ".join(PLACEHOLDERS)))
WORD = re.compile(rf"(?:[^\W\d_ក-៿]|[{INVISIBLE}])+|[ក-៓ៗ៝{INVISIBLE}]+")
LABEL_BEFORE = re.compile(rf"{LABELS}\s*\*{{0,2}}\s*\Z", re.I)
#: One of these stands in every declining phrase.
DECLINE = ("can", "able", "allowed", "permitted", "going to", "decline", "refuse", "appropriate", "guidelines", "polic", "giving", "blocked", "denied", "មិនអាច", "បដិសេធ", "មិនត្រូវបានអនុញ្ញាត", "មិនអនុញ្ញាត", "ហាមឃាត់")
RUNS = re.compile("|".join(f"(?P<{k}>{v.pattern}+)" for k, v in SCRIPTS.items()))
ENDS = 64
ECHO = 0.36  # bytes that an echo costs for each of its own at most; texts on one subject cost 0.4 and more
FILLER = b"\x00zq|7#K~w\x01vX^5jY_d\x02Gb!9uM"


UNSEEN = dict.fromkeys(map(ord, INVISIBLE))


def prose(text: str) -> str:
    """The text without formulas, code, labels and tags."""
    text = FORMULA.sub(" ", text)
    if "<" in text:
        text = re.sub(r"</?[A-Za-z][^<>]*>", " ", text)
    parts = re.split("[:៖]", text)  # a label stands right before a colon
    return " ".join([LABEL_BEFORE.sub(" ", p) if LABEL_BEFORE.search(p, max(0, len(p) - 60)) else p for p in parts[:-1]] + parts[-1:])


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    framed = "<" in answer or "&" in answer or "\\begin" in answer or "```" in answer
    if not framed and any((w := m.group().translate(UNSEEN).lower()) and w not in FRAME for m in WORD.finditer(answer)):
        return False
    text = answer.translate(UNSEEN)
    if framed:
        text = re.sub(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:nbsp|#160|zwnj|zwj);", " ", text, flags=re.S)
        text = re.sub(r"\\begin\{\w+\*?\}\s*\\end\{\w+\*?\}", " ", text)
        text = re.sub(r"```\w*[ \t]*\n?\s*```", " ", text)
    text = LABEL.sub(" ", text)
    text = re.sub(rf"^\W*{LABELS}\W*$", " ", text, flags=re.I)
    bare = " ".join(re.sub(r"[^\w/]+", " ", text).split()).strip("/_ ").lower()
    return not bare or bare in PLACEHOLDERS


def is_refusal(answer: str) -> bool:
    """Declines, and what is left beside the declining sentences is no solution."""
    low = answer.lower()
    if not any(x in low for x in DECLINE):
        return False
    text = answer.replace("’", "'")
    if not REFUSALS.search(text):
        return False
    rest = [s for s in re.split(r"(?<=[.!?។៕])\s*|\n+", text) if s.strip() and not REFUSALS.search(s) and not COURTESY.search(s)]
    left = sum(c.isalnum() for s in rest for c in s)
    return left < 12 and not any(LABEL_BEFORE.search(p) for p in re.split("[:៖]", text)[:-1])


def written_in(text: str) -> tuple[str | None, float]:
    """The main language of the prose and its share of the letters."""
    letters = dict.fromkeys(SCRIPTS, 0)
    for m in RUNS.finditer(text):
        letters[m.lastgroup] += m.end() - m.start()
    total = sum(letters.values())
    if total < 4:
        return None, 0.0
    script = max(letters, key=lambda k: letters[k])
    share = letters[script] / total
    if script != "la":
        return script, share
    words = re.findall(r"[a-zà-ɏ]+", text.lower())
    hits = {k: sum(w in d for w in words) for k, d in COMMON.items()}
    best = max(hits, key=lambda k: hits[k])
    return (best if hits[best] > 2 * hits["en"] and hits[best] >= 2 else "en"), share


def is_wrong_language(answer: str, language: str | None, prompt: str) -> bool:
    if not language:
        return False
    got, share = written_in(prose(answer))
    if got is None or got == language or share < 0.5:
        return False
    return not (got in ASKS and ASKS[got].search(prompt))


def squeeze(text: str) -> str:
    """Lower case without quotation, marks and blanks at the ends, and without an announcement."""
    text = text.strip().lower()
    text = re.sub(ASKED, "", text.lstrip("*_\"'“‘«`( "), flags=re.I)
    return " ".join(text.strip("*_\"'“”‘’«»`()>.…!?។៕ ").split())


def dictionary_cost(text: str, words: str) -> float:
    """Bytes that zstandard needs for each byte of the text with ``words`` as dictionary.

    A common beginning of both, whose own cost is taken off, lets texts of a few bytes be matched too.
    """
    data = text.encode()
    known = zstandard.ZstdCompressionDict(FILLER + words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(made.compress(FILLER + data)) - len(made.compress(FILLER))) / max(len(data), 1)


def is_echo(answer: str, prompt: str) -> bool:
    """Whether the answer costs next to nothing when the prompt is known and holds most of the prompt; both in canonical form."""
    a, p = squeeze(answer), squeeze(prompt)
    if not a or not p or len(a) > 1.35 * len(p) + 12 or len(a) < 0.6 * len(p):  # much longer or shorter is something else
        return False
    return dictionary_cost(a, p) <= ECHO and dictionary_cost(p, a) <= 2 * ECHO


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of a character: letters by script, digits, marks one by one."""
    out = np.full(0x110000, 1, np.uint8)
    for i, (a, b) in enumerate(((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1780, 0x17D3), (0x900, 0x963), (0x3400, 0x9FFF))):
        out[a : b + 1] = 2 + i
    for a in (0x30, 0x660, 0x966, 0x17E0):
        out[a : a + 10] = 8
    out[[9, 10, 32, 0xA0]] = 0
    for i, c in enumerate(".!?…។៕៖।॥。！？，、；：,;:)]}\"'”’»」』$*_`>-=+\\/(["):
        out[ord(c)] = 9 + i
    return out


def contexts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring kinds anywhere, and the kinds at the end of each text; blanks are left out."""
    points = flatten(column)
    stop = points == 0x10FFFF
    k = kinds()[np.minimum(points, 0x10FFFE)].astype(np.int64)
    keep = (k > 0) | stop
    k, stop = k[keep], stop[keep]
    pair = k[:-1] * ENDS + k[1:] if len(k) > 1 else np.empty(0, np.int64)
    inside = ~(stop[:-1] | stop[1:]) if len(k) > 1 else np.empty(0, bool)
    counts = np.bincount(pair[inside], minlength=ENDS * ENDS)
    at = np.flatnonzero(stop)
    before = np.r_[-1, at[:-1]]
    last = np.where(at - before > 1, k[np.maximum(at - 1, 0)], 0)
    previous = np.where(at - before > 2, k[np.maximum(at - 2, 0)], 0)
    return counts, previous * ENDS + last


def terminal_model(answers: DataFrame) -> np.ndarray:
    """Chance, by context, that a text ends there, from all answers (text, limited: stopped at the length limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, ends = np.zeros(ENDS * ENDS, np.int64), np.zeros(ENDS * ENDS, np.int64)
        for b in batches:
            counts, last = contexts(b.column(0))
            inside += counts
            ends += np.bincount(last[~b.column(1).to_numpy(zero_copy_only=False)], minlength=ENDS * ENDS)
        at = np.flatnonzero(inside + ends)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(inside[at]), pa.array(ends[at])], names=["context", "inside", "ends"])

    rows = answers.mapInArrow(run, "context int, inside long, ends long").groupBy("context").agg(F.sum("inside"), F.sum("ends")).toArrow()  # ENDS * ENDS rows at most
    inside, ends = np.zeros(ENDS * ENDS), np.zeros(ENDS * ENDS)
    at = rows.column(0).to_numpy()
    inside[at], ends[at] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    # a context backs off to its last character
    all_in, all_end = inside.reshape(ENDS, ENDS).sum(0), ends.reshape(ENDS, ENDS).sum(0)
    back = (all_end + 0.02) / (all_in + 1)
    return ((ends.reshape(ENDS, ENDS) + 4 * back) / (inside.reshape(ENDS, ENDS) + 4)).ravel()


def open_ended(text: str) -> bool:
    """A formula, emphasis, quotation or list label that is begun and not closed."""
    t = text.rstrip()
    if "$" in t and (t.count("$$") % 2 or re.sub(r"\$\$.*?\$\$", "", t, flags=re.S).replace("\\$", "").count("$") % 2):
        return True
    if t.count("**") % 2 or t.count("```") % 2 or t.count("\\[") > t.count("\\]"):
        return True
    if any(c in t for c in "“«「『"):
        plain = FORMULA.sub("", t)
        if any(plain.rfind(a) > plain.rfind(b) for a, b in ("“”", "«»", "「」", "『』")):
            return True
    if not t.endswith((":", "៖", "*")):
        return False
    m = None
    for m in LABEL.finditer(t):
        pass
    return bool(m and m.end() == len(t))


def is_limited(stop_reason: str = "stop_reason") -> Column:
    return F.coalesce(F.lower(stop_reason).isin(*LENGTH_STOPS), F.lit(False))


def label_pairs(pairs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Add ``defects`` (array of the types in DEFECTS, perhaps empty) to answer pairs.

    ``pairs``: response_id, answer, language, stop_reason, prompt. A null answer is empty; a null prompt
    counts as empty text; a null language is never wrong; a null stop reason says nothing. An echo is not
    also truncated. Response ids are not checked for repeats. The terminal contexts are counted in
    ``answers`` (answer, stop_reason), by default those of the pairs.
    """
    spark = pairs.sparkSession
    p = pairs.select("response_id", "answer", "language", is_limited().alias("limited"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    ends = (pairs if answers is None else answers).where(F.col("answer").isNotNull()).select("answer", is_limited().alias("limited"))
    model = spark.sparkContext.broadcast(terminal_model(ends))  # ENDS * ENDS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = model.value
        for b in batches:
            answers = b.column(1).to_pylist()
            _, last = contexts(b.column(1))
            plain, asked = normalise(b.column(1)).to_pylist(), normalise(b.column(4)).to_pylist()
            languages, stopped = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = []
            for i, answer in enumerate(answers):
                labels = []
                if is_empty(answer):
                    labels.append("empty")
                    if stopped[i]:
                        labels.append("truncated")
                else:
                    echo = is_echo(plain[i], asked[i])
                    if not echo and (stopped[i] or chance[last[i]] < 0.01 or open_ended(answer)):
                        labels.append("truncated")
                    if is_refusal(answer):
                        labels.append("refusal")
                    if echo:
                        labels.append("echo")
                    if is_wrong_language(answer, languages[i], asked[i]):
                        labels.append("wrong_language")
                out.append(labels)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["response_id", "defects"])

    return p.mapInArrow(run, T.StructType([T.StructField("response_id", T.LongType()), T.StructField("defects", T.ArrayType(T.StringType()))]))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with the prompts they answer, of requests with generate true, labelled.

    Repeated rows are dropped behind the join, where they lie together already; the contexts are counted
    where the responses are read, which takes no shuffle.
    """
    q = spark.read.parquet(f"{sf_dir}/query_requests.parquet").where("generate").select("request_id", "prompt")
    r = spark.read.parquet(f"{sf_dir}/query_responses.parquet").select("response_id", "request_id", "answer", "language", "stop_reason").where(F.col("response_id").isNotNull())
    return label_pairs(r.join(q, "request_id").dropDuplicates(["request_id", "response_id"]), r)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("response_id", F.explode("defects").alias("defect")).distinct()
