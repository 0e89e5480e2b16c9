"""Broken prompt and response pairs: empty, truncated, refused, copied answers and answers in another language.

Each answer is read by a pushdown parser (fences, brackets, quotations, escapes), which tells what it says as reason
and what was still open where it stopped. Copies are found by greedy string tiling against the prompt, refusals by a
grammar, other languages by scripts and function words. Whether a reason that stops without a full stop is complete is
judged by the corpus: how often its last words end a complete reason and how often they go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import materialize
from siltstone.sources import table

COPY_SHARE, MIN_TILE = 0.85, 3
#: Words before an end that are compared with the corpus, the start of the reason counting as one.
GRAMS = 8

_PAIR = {"{": "}", "[": "]"}
_KEY = re.compile(r'"(\w+)"\s*:\s*$')
_BARE = re.compile(r"null|true|false|-?[\d.]+")
_EMPTY = re.compile(r"^[\s`'\"\[\]{}():;,.\-]*$")
_FIELDS = re.compile(r"(?im)(?:^|;\s*)(aspect|claim|quote)\s*(?:[:=]\s*|\n)")
_PREFIXES = [
    re.compile(r"(?is)^\s*(?:here is the verdict|verdict|answer|judge?ment|result)\b\s*:?\s*"),
    re.compile(r"(?is)^\s*(?:yes|no|partial)\s*[,/]\s*(?:yes|no|partial)\s*[-–—.:;]\s*"),
    re.compile(r"(?is)^\s*(?:supports?|answers?|quote_supports_claim|answers_aspect)\s*[=:]\s*(?:yes|no|partial)\s*[;,.]?\s*"),
    re.compile(r"(?is)^\s*(?:yes|no|partial)\s*[:.;]\s*"),
    re.compile(r"(?is)^\s*reason\s*[:=]\s*"),
]
_TERMINATED = re.compile(r"""[.!?。！？]["'”’»)\]]*\s*$""")
_ELLIPSIS = re.compile(r"(\.\.\.|…)\s*$")
_WORDS = re.compile(r"\w+", re.UNICODE)

_HAN, _KANA = re.compile("[一-鿿]"), re.compile("[぀-ヿ]")
# Languages told by their script alone.
_SCRIPTS = {"ru": re.compile("[Ѐ-ӿ]"), "ko": re.compile("[가-힣]"), "el": re.compile("[Ͱ-Ͽ]"), "ar": re.compile("[؀-ۿ]"), "he": re.compile("[֐-׿]"), "hi": re.compile("[ऀ-ॿ]"), "th": re.compile("[฀-๿]")}
# Function words by language, for telling languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are this be by not or from which but have has an at its does only while how what when so than nor neither",
    "de": "der die das und ist nicht ein eine zu mit den von dem des wie auf sich für es aus nur aber wird oder bei als auch zwar jedoch nach sind im wurden über",
    "fr": "le la les des et est une du pas que dans en pour qui ce il au sur par ne se plus donc mais avec cette été ou sont aux rien comment",
    "es": "el la los las que y es una por con no se del para pero como lo su al más solo este esta son fue si cuando cómo sin sobre",
    "pt": "o a os as que e é uma por com não se do da para mas como no na em ao mais só dos das foi são um porém",
    "it": "il lo la gli le che e è una per con non si del della ma come nel più solo questo questa sono un di al",
    "nl": "de het een en van is niet dat op te met voor zijn aan maar ook wordt door er hoe naar bij om als",
}
_LEXICON = {w: [k for k, words in FUNCTION_WORDS.items() if w in words.split()] for words in FUNCTION_WORDS.values() for w in words.split()}
# Words after which a sentence goes on.
OPEN_ENDS = set(
    "the a an of and or but nor to in on at by with from for as that which because while whereas than is are was were be been has have had its their his her this these those not only about into if when where who whose between against over under both either neither does do did can could will would should may might must so also such more most very"
    " der die das den dem des ein eine einen einem einer und oder aber dass weil mit von zu zum zur im auf für bei als ist sind war wurde nicht sich durch über"
    " le la les des du de un une et ou mais que qui dans pour par sur avec en au aux est sont ne se ce cette"
    " el los las del una y o pero por con para al se su es son lo"
    " os da do dos das um uma e ou mas em no na ao com para é são"
    " и в на не с по к из за о от для что но а как".split()
)

_ACT = r"(?:judg\w*|rat(?:e|ing)|evaluat\w*|assess\w*|answer\w*|respond\w*|repl(?:y|ies)|help|assist|complet\w*|provid\w*|giv(?:e|ing)|compl(?:y|ies)|process|handle|engage|offer|perform|decid\w*|comment|continue|proceed|score|grade|review|fulfil\w*|do that|do this|discuss|work on|support)"
_NOT = r"(?:can(?:no|')?t|can ?not|could(?: not|n't)|won['’]t|will not|would not|wouldn['’]t|do(?:es)? not|don['’]t|doesn['’]t|am not|['’]m not|is not|isn['’]t|are not|may not|must not|must decline|have to decline|has to decline|need to decline|decline|declines|refuse|refuses|have to refrain|must refrain|refrain|unable|not able|prefer not|rather not|not possible|not allowed|not permitted|not authori[sz]ed)"
_REFUSALS = [
    # who, some form of not, and the act of judging soon after
    rf"\b(?:i|we|the assistant|this assistant|the model|this model|the system)\b[^.!?]{{0,25}}?{_NOT}(?:\s+\w+){{0,7}}?\s+{_ACT}\b",
    rf"\bi['’](?:d|m|ll)\s+(?:\w+\s+){{0,2}}?{_NOT}(?:\s+\w+){{0,7}}?\s+{_ACT}\b",
    rf"\bnot possible for (?:me|us|the assistant|this assistant)\b",
    rf"\b(?:request|task|prompt|question)s?\b[^.!?]{{0,20}}\b(?:denied|declined|refused|rejected|blocked|not supported|not allowed)\b",
    r"^\W*(?:declined|refused|denied|request denied|blocked|rejected)\b",
    r"\b(?:outside|beyond|against|violat\w+|contrary to|not within|falls outside)\b[^.!?]{0,30}\b(?:guidelines?|polic(?:y|ies)|usage|rules|the assistant|this assistant|permitted|allowed|supports)\b",
    r"\bno (?:judge?ment|verdict|answer|rating|evaluation|assessment|response|reply|score|opinion)\b[^.!?]{0,15}\b(?:will|can|shall|is|could|may)\b[^.!?]{0,20}\b(?:given|provided|returned|offered|made|issued|produced|available)\b",
    r"\b(?:evaluation|rating|judge?ment|assessment|judging|grading)\b[^.!?]{0,40}\b(?:is|are|cannot be|can not be|will not be)\b[^.!?]{0,12}\b(?:not )?(?:offered|provided|supported|permitted|performed|available|done here)\b",
    r"\bnot suitable for (?:automated|automatic)\b",
    r"\bnothing (?:is|will be) returned\b",
    r"\b(?:does|do) not respond to requests\b",
    # German
    r"\b(?:ich|wir)\b[^.!?]{0,40}\b(?:nicht|keine?n?)\b[^.!?]{0,40}\b(?:bearbeiten|beantworten|beurteilen|bewerten|abgeben|helfen|antworten|geben|einschätzen|durchführen)\b",
    r"\b(?:kann|darf|möchte|werde) ich\b[^.!?]{0,40}\b(?:nicht|keine?n?)\b",
    r"\banfrage\b[^.!?]{0,50}\b(?:abgelehnt|nicht (?:bearbeit|beantwort|zuläss|erlaubt|möglich)\w*)",
    r"\b(?:muss|müssen|möchte|will|werde)\b[^.!?]{0,25}\b(?:ablehnen|verweigern|verzichten|absehen)\b|\blehne\b[^.!?]{0,40}\bab\b",
    # French
    r"\b(?:dois|devons|préfère|souhaite)\b[^.!?]{0,20}\b(?:refuser|décliner|m['’]abstenir)\b|\bje (?:refuse|décline)\b",
    r"\bje (?:ne|n['’])\s?\w+[^.!?]{0,12}\b(?:pas|point|regrette|refuse)\b",
    r"\bje (?:suis|regrette|refuse|préfère|m['’])\b[^.!?]{0,60}\b(?:évaluer|juger|répondre|traiter|aider|noter|autorisé|désolé|pas)\b",
    r"\b(?:cette )?demande\b[^.!?]{0,40}\b(?:dépasse|refusée|rejetée|hors|autorisé)\b",
    # Spanish
    r"\b(?:no (?:puedo|podemos|me (?:es|está)|debo|voy a|quiero)|lo siento)\b[^.!?]{0,60}",
    r"\bsolicitud\b[^.!?]{0,40}\b(?:rechazada|denegada|no (?:está|puede))\b",
    r"\b(?:debo|tengo que|prefiero|quiero)\b[^.!?]{0,20}\b(?:negarme|rechazar|declinar|abstenerme)\b|\b(?:rechazo|declino) (?:juzgar|evaluar|responder)\b",
    # Portuguese
    r"\b(?:devo|tenho de|tenho que|prefiro)\b[^.!?]{0,20}\b(?:recusar|declinar|abster|negar)\w*",
    r"\b(?:não (?:posso|podemos|me é|devo|vou|quero|estou)|lamento|sinto muito|desculpe)\b[^.!?]{0,60}",
    # Italian, Dutch
    r"\b(?:non posso|mi dispiace)\b",
    r"\b(?:ik kan|ik mag|het spijt)\b[^.!?]{0,40}\b(?:niet|geen)\b",
    # Russian, Chinese
    r"(?:я|мы|мне)\s[^.!?]{0,20}не\s(?:могу|можем|буду|вправе|имею|готов\w*|разрешено|положено)|не могу\b[^.!?]{0,40}(?:оцен|ответ|выполн|помо|суд)|(?:извините|простите|к сожалению|прошу прощения)[^.!?]{0,60}\bне\b|запрос\w*[^.!?]{0,30}(?:отклон|не\s)|отказыва\w+|отказаться",
    # leaving it to others: one who speaks, a preference, and the act of handing on
    r"\b(?:i|we)\b[^.!?]{0,20}\b(?:rather|prefer|choose|have) (?:to |not to )?(?:leave|hand|pass|skip|defer|abstain)\b",
    r"\b(?:überlass\w*|enthalt\w*)\b[^.!?]{0,20}\b(?:ich|wir|mich|uns)\b|\b(?:ich|wir)\b[^.!?]{0,20}\b(?:überlass\w*|enthalt\w*)\b",
    # Japanese
    r"(?:できません|できかね|いたしかね|お断り|お答え(?:でき|し)|控えさせ|差し控え)",
    r"(?:抱歉|对不起|很遗憾|无法(?:回答|评|判|提供|处理|完成|协助)|不能(?:回答|评|判|提供|处理|完成|协助)|(?:必须|只能)?拒绝|不便(?:回答|评|判))",
]
_REFUSAL = [re.compile(p, re.IGNORECASE | re.UNICODE) for p in _REFUSALS]
# What a judge may not find or confirm without declining to judge.
_FINDING = re.compile(r"\b(?:can(?:no|')?t|can ?not|could not|unable to|do(?:es)? not)\s+(?:find|see|locate|verify|confirm|support|reproduce|establish|show|describe|mention|depend|state|say|explain)\b", re.IGNORECASE)


_TAG = re.compile(r"<(/?)([A-Za-z_][\w-]*)[^<>]*>")
_BULLET = re.compile(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+(?=(?:reason|supports?|answers?|verdict|quote_supports_claim|answers_aspect)\b)", re.IGNORECASE)


def without_markup(text: str) -> str:
    """What a free answer says: the words of its reason tag where it has one, else all words, tags and list marks of its
    fields off. Tags are kept on a stack; a closer ends the last tag of its name and what was left open in it."""
    stack: list[str] = []
    said, reason, upto = [], None, 0
    for m in _TAG.finditer(text):
        (reason if reason is not None and "reason" in stack else said).append(text[upto : m.start()])
        upto, name = m.end(), m.group(2).lower()
        if not m.group(1):
            stack.append(name)
            if name == "reason":
                reason = []
        elif name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name) :]
    (reason if reason is not None and "reason" in stack else said).append(text[upto:])
    body = "".join(reason) if reason is not None else " ".join(said) if upto else text
    return _BULLET.sub("", body).strip().strip('"').strip()


def parse_answer(raw: str) -> dict:
    """What an answer holds: ``reason`` (None if it has none), ``verdict`` flag, ``closed`` (the reason's own quotation
    was ended), ``open`` (a JSON object was begun and its reason not reached)."""
    text = re.sub(r"^\s*`{3}\w*\s*|\s*`{3}\s*$", "", raw)
    at = text.find("{")
    if at < 0:
        body = without_markup(text)
        if _EMPTY.match(text) or body.lower() in ("null", "none", "n/a"):
            return {"reason": None, "verdict": False, "closed": False, "open": False, "json": False}
        changed, verdict = True, False
        while changed:
            changed = False
            for i, p in enumerate(_PREFIXES):
                m = p.match(body)
                if m and m.end():
                    verdict = verdict or i in (1, 2, 3)
                    body, changed = body[m.end() :], True
        return {"reason": body or None, "verdict": verdict, "closed": False, "open": not body and verdict, "json": False}
    stack, fields, key, i, n = [], {}, None, at, len(text)
    string_open = False
    while i < n:
        c = text[i]
        if c in _PAIR:
            stack.append(_PAIR[c])
        elif stack and c in stack:  # a closer ends its own bracket and those left open inside
            del stack[len(stack) - 1 - stack[::-1].index(c) :]
            if not stack:
                break
        elif c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            value = text[i + 1 : min(j, n)]
            closed = j < n
            rest = text[j + 1 :].lstrip() if closed else ""
            if closed and rest.startswith(":") and key is None:
                key = value
            elif key is not None:
                fields[key] = (value, closed)
                key = None
            string_open = not closed
            i = j
        elif key is not None and c not in ": \t\r\n,":
            m = _BARE.match(text, i)
            fields[key] = ("" if m and m.group(0) == "null" else m.group(0) if m else "", True)
            key = None
            i = m.end() - 1 if m else i
        elif c == "," and key is not None:
            key = None
        i += 1
    reason, closed = fields.get("reason", (None, False))
    if reason is not None:
        reason = re.sub(r'\\(["\\/])', r"\1", reason).replace("\\n", " ").replace("\\t", " ").strip()
    verdict = any(v.strip() for k, (v, _) in fields.items() if k != "reason")
    unfinished = bool(stack) or string_open
    return {"reason": reason or None, "verdict": verdict, "closed": closed, "open": unfinished and reason is None, "json": True}


@lru_cache(maxsize=4096)
def language_of(text: str) -> str | None:
    """Language by script and function words, quoted words aside; None where too little speaks for one."""
    plain = re.sub(r"«[^»]*»|“[^”]*”|\"[^\"]*\"|‘[^’]*’|「[^」]*」", " ", text)
    if not plain.isascii():
        letters = "".join(c for c in plain if c.isalpha())
        kana, han = len(_KANA.findall(letters)), len(_HAN.findall(letters))
        if kana and (kana + han) * 4 > len(letters):
            return "ja"
        if han * 4 > len(letters):
            return "zh"
        for language, script in _SCRIPTS.items():
            if len(script.findall(letters)) * 2 > len(letters):
                return language
    score: dict[str, float] = {}
    for w in _WORDS.findall(plain.lower()):
        for k in _LEXICON.get(w, ()):
            score[k] = score.get(k, 0) + 1 / len(_LEXICON[w])
    ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < 1.5 or (len(ranked) > 1 and ranked[0][1] < 1.25 * ranked[1][1]):
        return None
    return ranked[0][0]


def tiled_share(answer: list[str], prompt: list[str], min_tile: int = MIN_TILE) -> float:
    """Share of the answer's words covered by common runs with the prompt, the longest free one each time, no word used
    twice. Equal runs go to the earlier place. What is left free of a run that another one cut waits for its own turn."""
    if len(answer) < min_tile or len(prompt) < min_tile:
        return 0.0
    starts: dict[tuple, list[int]] = {}
    for j, gram in enumerate(zip(*(prompt[k:] for k in range(min_tile)))):
        starts.setdefault(gram, []).append(j)
    heap: list[tuple[int, int, int]] = []
    for i, gram in enumerate(zip(*(answer[k:] for k in range(min_tile)))):
        for j in starts.get(gram, ()):
            if i and j and answer[i - 1] == prompt[j - 1]:
                continue
            k = min_tile
            while i + k < len(answer) and j + k < len(prompt) and answer[i + k] == prompt[j + k]:
                k += 1
            heap.append((-k, i, j))
    heapify(heap)
    used_a, used_p = [False] * len(answer), [False] * len(prompt)
    while heap:
        k, i, j = heappop(heap)
        free = [not used_a[i + x] and not used_p[j + x] for x in range(-k)]
        if all(free):
            for x in range(-k):
                used_a[i + x] = used_p[j + x] = True
            continue
        x = 0
        while x < -k:
            y = x
            while y < -k and free[y]:
                y += 1
            if y - x >= min_tile:
                heappush(heap, (x - y, i + x, j + x))
            x = y + 1
    return sum(used_a) / len(answer)


def may_be_copied(answer: list[str], prompt: list[str], share: float = COPY_SHARE, min_tile: int = MIN_TILE) -> bool:
    """False where even all runs of ``min_tile`` words that stand in the prompt cover too little of the answer: tiles are
    made of them, so that nothing :func:`tiled_share` would find is passed over."""
    grams = set(zip(*(prompt[k:] for k in range(min_tile))))
    covered, upto = 0, 0
    for i, gram in enumerate(zip(*(answer[k:] for k in range(min_tile)))):
        if gram in grams:
            covered += i + min_tile - max(i, upto)
            upto = i + min_tile
    return bool(answer) and covered >= share * len(answer)


def is_refusal(text: str) -> bool:
    plain = re.sub(r"«[^»]*»|“[^”]*”|\"[^\"]*\"", " ", text)
    return any(p.search(_FINDING.sub(" ", plain)) for p in _REFUSAL)


def prompt_parts(prompt: str) -> str:
    """Aspect, claim and quote of a prompt; the whole prompt where it is laid out otherwise."""
    found = list(_FIELDS.finditer(prompt))
    if len(found) < 2:
        return prompt
    ends = [m.start() for m in found[1:]] + [len(prompt)]
    return "\n".join(prompt[m.end() : e] for m, e in zip(found, ends))


def _grams(words: list[str]) -> list[str]:
    return [" ".join(words[-k:]) for k in range(1, min(GRAMS, len(words)) + 1)]


def _tokens(text: str) -> list[str]:
    return ["^", *(re.sub(r"\d+", "0", w) for w in _WORDS.findall(text.lower()))]


def inspect(raw: str | None, prompt: str | None) -> tuple[str | None, str, str]:
    """(defect or None, state, reason): state is ``done``, ``closed`` or ``loose``, for reasons without full stop."""
    raw, prompt = raw or "", prompt or ""
    p = parse_answer(raw)
    reason = p["reason"]
    if reason is None and not p["verdict"]:
        return ("truncated" if p["open"] and re.search(r'"\w', raw) else "empty"), "done", ""
    if reason is None:
        return ("truncated" if p["open"] else None), "done", ""
    said, given = _WORDS.findall(reason.casefold()), _WORDS.findall(prompt.casefold())
    if may_be_copied(said, given) and tiled_share(said, given) >= COPY_SHARE:
        return "copied", "done", reason
    if is_refusal(reason):
        return "refusal", "done", reason
    if _ELLIPSIS.search(reason):
        return "truncated", "done", reason
    terminated = bool(_TERMINATED.search(reason))
    if not terminated:
        tail = _WORDS.findall(reason.lower())[-1:] or [""]
        if tail[0] in OPEN_ENDS or re.search(r"[,;:(\-–—«“\"]\s*$", reason) or reason.count("(") > reason.count(")") or reason.count("«") > reason.count("»"):
            return "truncated", "done", reason
    mine, asked = language_of(reason), language_of(prompt_parts(prompt))
    defect = "other_language" if mine and asked and mine != asked else None
    return defect, "done" if terminated else "closed" if p["closed"] else "loose", reason


def find_defects(verdicts: DataFrame) -> DataFrame:
    """Defective answers (verdict_id, defect), one type each: empty, copied, refusal, truncated, other_language in this
    order of precedence.

    Reads verdict_id, prompt and raw_output only: error and the parsed fields are not trusted. A null raw_output is
    empty; a null prompt means that nothing can be copied or in another language; repeated rows are judged each; empty
    tables give no rows; further columns are ignored; long texts are read whole.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, raw, prompt in zip(pdf["verdict_id"], pdf["raw_output"], pdf["prompt"]):
                defect, state, reason = inspect(raw, prompt)
                words = _tokens(reason)
                rows.append((key, defect, state, _grams(words) if state != "done" else [], words if defect is None and reason else []))
            yield pd.DataFrame(rows, columns=["verdict_id", "defect", "state", "ends", "words"])

    seen = verdicts.select("verdict_id", "raw_output", "prompt").mapInPandas(scan, "verdict_id long, defect string, state string, ends array<string>, words array<string>")
    seen = materialize(seen, "answers")
    doubtful = seen.where(F.size("ends") > 0).select("verdict_id", "defect", "state", F.posexplode("ends").alias("n", "gram"))
    wanted = doubtful.select("gram").distinct()
    complete = seen.where((F.col("state") != "loose") & (F.size("words") > 0))
    ends = wanted.where(~F.col("gram").contains(" ")).select(F.col("gram").alias("end"))
    places = complete.select("words", F.posexplode("words").alias("e", "end")).withColumn("e", F.col("e") + 1).join(ends, "end", "left_semi")
    grams = F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAMS), F.col("e"))), lambda k: F.array_join(F.slice(F.col("words"), F.col("e") - k + 1, k), " "))
    counted = (
        places.select((F.col("e") == F.size("words")).cast("long").alias("final"), F.explode(grams).alias("gram"))
        .join(wanted, "gram", "left_semi")
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("final").alias("finals"))
    )
    longest = Window.partitionBy("verdict_id").orderBy(F.desc("n"))
    rated = doubtful.join(counted, "gram").where(F.col("total") >= 3).withColumn("_r", F.row_number().over(longest)).where(F.col("_r") == 1)
    rated = rated.select("verdict_id", (F.col("finals") / F.col("total")).alias("p"), "total")
    judged = seen.where(F.col("state") != "done").join(rated, "verdict_id", "left")
    cut = F.when(F.col("state") == "loose", F.coalesce(F.col("p"), F.lit(0.0)) < 0.3).otherwise((F.col("p") < 0.02) & (F.col("total") >= 5))
    late = judged.select("verdict_id", F.when(F.coalesce(cut, F.lit(False)), F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))
    early = seen.where(F.col("state") == "done").select("verdict_id", "defect")
    return early.unionByName(late).where(F.col("defect").isNotNull())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_defects(table(spark, sf_dir, "judge_verdicts"))
