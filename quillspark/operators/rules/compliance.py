"""Compliance rules: safety, approval, revision, ISO 9001, FDA, WHO, SOP form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ...fixed import words as W
from ...functions import rx
from ...functions.findings import issue, none, only_if, present
from ..parse import Doc


def heading_mentions(d: Doc, words: list[str]) -> Column:
    return F.exists(d.headings, lambda h: rx.contains_any(F.lower(h["title"]), words))


def safety_warning(d: Doc, cfg: dict) -> Column:
    """The active form: the text names a warning at all."""
    return only_if(~rx.contains_any(d.lower, ["warning", "cảnh báo"]), issue("no-warning"))


def safety_score(d: Doc, cfg: dict) -> Column:
    """The shadowed form: warnings + hazard symbols + 2 for a safety section."""
    section = heading_mentions(d, ["safety", "warning"])
    score = rx.contained(d.lower, W.WARNING_WORDS) + rx.contained(d.text, W.HAZARD_SYMBOLS) + section.cast("int") * 2
    return (
        F.when(~d.is_profile("sop"), none())
        .when(score == 0, F.array(issue("no-safety")))
        .when((score < 3) & ~section, F.array(issue("little-safety", score=score)))
        .otherwise(none())
    )


def signatures(d: Doc, cfg: dict) -> Column:
    signed = d.lower.rlike(rx.fold(W.SIGNATURE)) | heading_mentions(d, ["approval"])
    return F.when(d.is_profile("sop"), present(
        F.when(~signed, issue("no-signature")),
        F.when(~d.text.rlike(rx.exact(W.DATE)), issue("no-date")))).otherwise(none())


def revision_history(d: Doc, cfg: dict) -> Column:
    version = d.lower.rlike(rx.fold(W.VERSION))
    return F.when(d.is_profile("sop"), present(
        F.when(~heading_mentions(d, W.REVISION_HEADINGS),
               issue("no-revision-history", severity=F.when(version, F.lit("medium")).otherwise(F.lit("high")))),
        F.when(~version, issue("no-version-number")))).otherwise(none())


def iso9001(d: Doc, cfg: dict) -> Column:
    return present(
        *[F.when(~d.lower.contains(word), issue("iso-missing", slug=word.replace(" ", "-"), display=display))
          for word, display in W.ISO_ELEMENTS],
        F.when(~rx.contains_any(d.lower, W.DOCUMENT_CONTROL), issue("iso-doc-control")))


def fda(d: Doc, cfg: dict) -> Column:
    found = rx.contained(d.lower, W.PART11_ELEMENTS)
    return present(
        F.when(~rx.contains_any(d.lower, W.GXP_TERMS), issue("fda-gxp")),
        F.when(found < 3, issue("fda-part11", count=found)))


def who(d: Doc, cfg: dict) -> Column:
    found = rx.contained(d.lower, W.WHO_ELEMENTS)
    return only_if(found < 4, issue("who", count=found))


def sop_validation(d: Doc, cfg: dict) -> Column:
    terms = rx.contained(d.lower, W.REGULATORY_TERMS)
    return F.when(d.is_profile("sop"), present(
        F.when(~rx.contains_any(d.lower, W.OBLIGATION_WORDS), issue("sop-no-imperative")),
        F.when(~d.text.rlike(rx.exact(W.NUMBERED_STEP)), issue("sop-no-steps")),
        F.when(terms < 3, issue("sop-regulatory", count=terms)))).otherwise(none())


def versioning(d: Doc, cfg: dict) -> Column:
    versions = rx.find_all(d.lower, rx.fold(W.VERSION), 1)
    drafts = F.transform(F.filter(versions, lambda v: v.startswith("0.")), lambda v: issue("draft-version", version=v))
    return (
        F.when(~d.is_profile("sop"), none())
        .when(~d.lower.rlike(rx.fold(W.VERSION)), F.array(issue("no-versioning")))
        .otherwise(drafts)
    )


def mandatory_sections(d: Doc, cfg: dict) -> Column:
    pack = cfg.get("pack_id", "")
    rows = W.PACK_SECTIONS.get(pack, [])
    if not rows:
        return none()
    return present(*[
        F.when(~d.lower.contains(word),
               issue("mandatory", pack=pack, pack_upper=pack.upper(), slug=word.replace(" ", "-"), display=display,
                     severity=severity))
        for word, display, severity in rows])


RULES = {
    "compliance.signatures": signatures, "compliance.revision-history": revision_history,
    "compliance.iso9001": iso9001, "compliance.fda": fda, "compliance.who": who,
    "compliance.sop-validation": sop_validation, "compliance.versioning": versioning,
    "compliance.mandatory-sections": mandatory_sections, "compliance.safety-warning": safety_warning,
}
SHADOWED = {"compliance.safety-warning": safety_score}
