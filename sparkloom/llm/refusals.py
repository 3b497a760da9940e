"""Refusals: a grammar of how answers decline, by language."""

from __future__ import annotations

import re

import ahocorasick

from .structure import visible
from .words import words

# The terminals of the grammar. A gap is text of the same sentence.
_GAP = r"[^.!?\n]{0,60}?"
_ENGLISH = {
    "subject": r"(?:i|we|the assistant|the model|this assistant|this model)",
    "negated": r"(?:can'?t|cannot|can not|could not|couldn'?t|won'?t|will not|(?:am|is|are|be|was) (?:unable|not able|not allowed|not permitted|not going|not in a position|not comfortable)|'m (?:unable|not \w+)|not (?:able|allowed|permitted|going|in a position|comfortable))",
    "act": r"(?:help|assist|answer|write|provide|comply|produce|respond|discuss|generate|fulfill?|do (?:that|this|so)|continue|share|complete|give|talk|touch|engage|offer|support)",
    "acting": r"(?:helping|assisting|answering|writing|providing|producing|responding|discussing|generating|doing|continuing|sharing|touching|going there)",
    "duty": r"(?:must|have to|need to|will have to|should|would prefer to|(?:has|have) chosen to|(?:has|have) decided to)",
    "decline": r"(?:pass|decline|refuse|skip|abstain|reject)",
    "declined": r"(?:declined|refused|rejected|skipped)",
}
# Each rule: groups of stems, of each of which one has to occur, and its pattern.
_RULES = {
    "en": [
        ("can't|cannot|cant |can not|could not|couldn't|couldnt|won't|wont |will not|unable|not able|not allowed|not permitted|not going|not in a|not comfortable", r"\b{subject}\b{gap}\b{negated} (?:be able )?(?:to )?(?:\w+ )?{act}\b|\b(?:unable|not able) to (?:\w+ )?{act}\b"),
        ("must |have to|need to|should |prefer to|chosen to|decided to & pass|declin|refus|skip|abstain|reject", r"\b{subject} (?:\w+ )?{duty} (?:\w+ )?{decline}\b"),
        ("i decline|we decline|i refuse|we refuse|i abstain|we abstain", r"\b(?:i|we) (?:decline|refuse|abstain)\b"),
        ("be declined|be refused|be rejected|be skipped", r"\b(?:has|have|had|needs?|must|will) (?:to )?be {declined}\b"),
        ("be given|be provided|be offered", r"\bno (?:answer|response|reply|help) (?:can|will|may) be (?:given|provided|offered)\b"),
        ("outside|beyond|above & what |my |our |the scope", r"\b(?:outside|beyond|above)(?: of)? (?:what (?:i|we)|my|our|the scope)\b"),
        ("appropriate for", r"\b(?:inappropriate|not appropriate) for (?:me|us)\b"),
        ("rather not", r"\b(?:(?:i|we)'d|(?:i|we) would) rather not\b"),
        ("information to", r"\b(?:do not|don't) have (?:enough|sufficient) information to {act}\b"),
        ("talk about something", r"\blet(?: us|'s) talk about something (?:other|else)\b"),
        ("not & helping|assisting|answering|writing|providing|producing|responding|discussing|generating|doing|continuing|sharing|touching|going there", r"\b(?:i am|i'm|we are|nope|no|sorry|but),? not {acting}\b|^not {acting}\b"),
    ],
    "de": [
        ("ich & nicht|keine|ablehnen", r"\b(?:kann|darf|möchte|werde|muss)\b{gap}\bich\b{gap}\b(?:nicht|nichts|keine|ablehnen)\b|\bich (?:kann|darf|möchte|werde|muss)\b{gap}\b(?:nicht|nichts|keine|ablehnen)\b|\b(?:bin ich|ich bin) (?:leider )?nicht (?:in der lage|befugt|berechtigt)\b"),
        ("ablehnen|abgelehnt", r"\b(?:anfrage|frage|bitte)\b{gap}\bab(?:lehnen|gelehnt)\b"),
    ],
    "fr": [
        ("je ne ", r"\bje ne (?:peux|suis|puis|veux|dois|saurais)\b{gap}\b(?:aider|répondre|pas en mesure|continuer|écrire|autorisé|dire)\b"),
        ("doit|dois & refus|déclin", r"\b(?:doit|dois) (?:être )?(?:refus|déclin)\w*"),
        ("je refuse|je décline|je préfère ne", r"\bje (?:refuse|décline|préfère ne pas)\b"),
    ],
    "es": [
        ("no puedo|no podemos|no estoy|no me es|no voy|no debo", r"\bno (?:puedo|podemos|estoy|me es posible|voy a|debo)\b{gap}\b(?:ayudar|responder|condiciones|autorizad[oa]|escribir|continuar|contestar)\b"),
        ("debo |tengo que & rechazar|declinar", r"\b(?:debo|tengo que) (?:rechazar|declinar)\b"),
        ("prefiero no", r"\bprefiero no\b"),
    ],
    "pt": [
        ("não posso|não podemos|não estou|não consigo|não vou|não devo", r"\bnão (?:posso|podemos|estou|consigo|vou|devo)\b{gap}\b(?:ajudar|responder|condições|autorizad[oa]|escrever|continuar)\b"),
        ("recusar|recusad", r"\b(?:devo|tenho de|preciso) recusar\b|\b(?:precisa|deve|tem de) ser recusad[oa]\b"),
        ("prefiro não", r"\bprefiro não\b"),
    ],
    "ja": [("でき|いたし|申し訳|お断り", r"(?:お答え|回答|お手伝い|対応)[^。]{{0,12}}(?:できません|できかねます|いたしかねます)|申し訳(?:ありません|ございません)|お断り")],
}
_GRAMMAR = [([group.split("|") for group in stems.split(" & ")], re.compile(rule.format(gap=_GAP, **_ENGLISH), re.I)) for rules in _RULES.values() for stems, rule in rules]


def _stems() -> ahocorasick.Automaton:
    """Finds in one pass, for each stem, the groups of the rules it belongs to."""
    owners: dict[str, set[tuple[int, int]]] = {}
    for rule, (groups, _) in enumerate(_GRAMMAR):
        for group, stems in enumerate(groups):
            for stem in stems:
                owners.setdefault(stem, set()).add((rule, group))
    found = ahocorasick.Automaton()
    for stem, groups in owners.items():
        found.add_word(stem, groups)
    found.make_automaton()
    return found


_STEMS = _stems()
_TECHNICAL = re.compile(r"[$#]\w|```|\b[A-Z]{3} [$#(]|\w\(")
_SENTENCE = re.compile(r"(?<=[.!?。])\s*(?=\S)(?!asm\b)|\n+")
#: Words of sentences beside the refusal itself, such as a pointer to someone else, for each of its own.
ASIDE = 3


def _rules(low: str) -> list[re.Pattern]:
    """The rules whose stems occur in a text in lower case."""
    hits = set().union(*(groups for _, groups in _STEMS.iter(low)))
    return [_GRAMMAR[rule][1] for rule in {r for r, _ in hits} if all((rule, k) in hits for k in range(len(_GRAMMAR[rule][0])))] if hits else []


def is_refusal(answer: str) -> bool:
    """Whether an answer declines and gives none.

    Each sentence declines by a rule of the grammar or is an aside: it holds nothing technical, and the
    asides together are at most ``ASIDE`` times as long as what declines. Texts are read whole.
    """
    text = answer.replace("’", "'")
    rules = _rules(text.lower())
    if not rules or not any(rule.search(text) for rule in rules):
        return False
    own = aside = 0
    for sentence in _SENTENCE.split(visible(text)):
        if any(rule.search(sentence) for rule in rules):
            own += len(words(sentence))
        elif _TECHNICAL.search(sentence):
            return False
        else:
            aside += len(words(sentence))
    return aside <= ASIDE * own
