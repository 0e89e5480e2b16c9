import pytest

from siltstone.llm import pairs

PROMPT = "Judge the item. Answer in JSON.\nASPECT\nHow do memories and experts differ in cost?\nCLAIM\nThe cost of experts does not depend on the size of the tax guidance.\nQUOTE\nAgreement between raters and Fepol was 61% over 1856 items in the study."


def full(reason, end='"}'):
    return '{"quote_supports_claim": "no", "answers_aspect": "yes", "reason": "' + reason + end


@pytest.mark.parametrize(
    "raw, defect",
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("[]", "empty"), ("null", "empty"), ('""', "empty"), ("```json\n```", "empty"),
        ('{"quote_supports_claim": null, "answers_aspect": null, "reason": null}', "empty"),
        ('{"quote_supports_claim": "", "answers_aspect": "", "reason": ""}', "empty"),
        ('{"quote_supports_claim": "no", "answers_a', "truncated"), ('{"quote_supports_claim": "no", "answers_aspect": "yes",', "truncated"),
        (full("The quote mentions that the embeddings were"), "truncated"), (full("Quote and claim agree..."), "truncated"),
        (full("The quote gives no number at all."), None), (full("The quote gives no number at all.", '"'), None),
        ("```json\n" + full("The quote gives no number at all.") + "\n```", None),
        ("Here is the verdict: " + full("I cannot find the stated figure in the quote."), None),
        ("Verdict: yes / yes. The authors were unable to reproduce it, which is the opposite.", None),
        (full("The passage refuses a causal reading and only gives a correlation."), None),
        (full("Sorry figures for recall are reported in the quote, in line with the claim."), None),
        ("Unfortunately, I must decline to judge this item.", "refusal"), (full("As an automated assistant, I can't help with that request."), "refusal"),
        ("Request denied. Evaluation of such passages is not offered.", "refusal"), ("No judgement will be given for this content.", "refusal"),
        ("I'd rather not rate the pair you sent; kindly rephrase the task.", "refusal"), ("Ich muss es ablehnen, diesen Inhalt zu beurteilen.", "refusal"),
        ("Je dois refuser de juger cet élément.", "refusal"), ("Debo negarme a juzgar este elemento.", "refusal"), ("К сожалению, я не могу оценить этот фрагмент.", "refusal"), ("抱歉，我无法评价这一内容。", "refusal"),
        ("I am sorry, but this is something I would rather leave to someone else", "refusal"), ("Das überlasse ich lieber anderen.", "refusal"), ("申し訳ありませんが、この項目は判断できません。", "refusal"),
        ("<verdict><supports>no</supports><reason>The quote gives no number at all.</reason></verdict>", None), ("<verdict><reason>The quote says that the", "truncated"),
        ("- supports: no\n- answers: yes\n- reason: The quote gives no number at all.", None), ('{"quote_supports_claim": ["no"}, "reason": "The quote gives no number at all."', None),
        (full("引用はその方法の働きを説明していない。"), "other_language"), (PROMPT, "copied"), (PROMPT.lower().replace("\n", " "), "copied"), (full("THE COST OF EXPERTS DOES NOT DEPEND ON THE SIZE OF THE TAX GUIDANCE !"), "copied"),
        (full('The claim that \\"The cost of experts does not depend on the size of the tax guidance\\" goes further than the passage.'), None),
        (full("Rien dans la citation n'explique le fonctionnement de la méthode."), "other_language"), (full("引文没有说明该方法如何运作。"), "other_language"),
        (full("Only the French term « preuve » is missing; the claim is supported by the quote."), None),
    ],
)
def test_one_answer(raw, defect):
    assert pairs.inspect(raw, PROMPT)[0] == defect


def test_same_language_is_no_defect():
    prompt = "Aspect: Wie funktioniert die Kürzung von Abschnitten?\nClaim: Die Übereinstimmung der Prüfer lag bei 73 Prozent.\nQuote: Insgesamt wurden 3706 Dokumente ausgewertet und die Fehler gezählt."
    assert pairs.inspect(full("Aus dem Zitat geht nicht hervor, wie das Verfahren arbeitet."), prompt)[0] is None
    assert pairs.inspect(full("The quote states the figure directly, so the claim is supported by it."), prompt)[0] == "other_language"


def test_tiling_uses_no_word_twice():
    assert pairs.tiled_share("a b c a b c".split(), "a b c".split()) == 0.5
    # the longest free run each time: d e f g goes first, a b c d e is left with a b c
    assert pairs.tiled_share("a b c d e f g h i".split(), "d e f g h i x a b c d e".split()) == 1.0
    answer, prompt = "u a b c d e v".split(), "a b c x c d e a b c d".split()
    assert pairs.tiled_share(answer, prompt) == 4 / 7
    assert not pairs.may_be_copied(answer, prompt) and pairs.may_be_copied("a b c d".split(), prompt)
    assert pairs.tiled_share([], ["a"]) == 0.0 and pairs.tiled_share("x y z".split(), []) == 0.0


def test_endings_without_full_stop_are_judged_by_the_corpus(spark):
    whole = [full(f"The claim says {i}.5 points while the quote gives no number at all.") for i in range(30)]
    rows = [(i, r, PROMPT, "error", 1) for i, r in enumerate(whole)]
    rows += [(100, full("The claim says 7.5 points while the quote gives no number at all", ""), PROMPT, None, 1), (101, full("The claim says 7.5 points while the quote gives no num", ""), PROMPT, None, 1), (102, "Verdict no: The claim says 7.5 points while the quote", PROMPT, None, 1), (103, full("Supported"), PROMPT, None, 1), (104, None, None, None, 1), (104, None, None, None, 1)]
    df = spark.createDataFrame(rows, "verdict_id long, raw_output string, prompt string, error string, gram int")
    got = sorted((r.verdict_id, r.defect) for r in pairs.find_defects(df).collect())
    assert got == [(101, "truncated"), (102, "truncated"), (104, "empty"), (104, "empty")]
    assert pairs.find_defects(df.limit(0)).count() == 0


def test_long_answer():
    reason = "The quote gives no number at all. " * 3000
    assert pairs.inspect(full(reason.strip()), PROMPT)[0] is None
