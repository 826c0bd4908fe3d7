"""The localized Markdown report of a scored review, rendered inside the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rx
from ..functions.findings import text_of

# --- fixed values: report labels -----------------------------------------------------
LABELS = {
    "en": {
        "title": "Quality Report", "profile": "Profile", "overall": "Overall Score", "status": "Status",
        "breakdown": "Score Breakdown", "category": "Category", "score": "Score", "grade": "Grade",
        "excellent": "Excellent", "good": "Good", "needs_work": "Needs Work", "summary": "Issue Summary",
        "severity": "Severity", "count": "Count", "autofixable": "Auto-Fixable",
        "autofix_sentence": "{count} issue(s) can be automatically fixed.",
        "no_issues": "No issues were detected. The document meets all quality standards.",
        "draft": "Draft", "review_needed": "Review Needed", "almost_ready": "Almost Ready", "ready": "Ready to Submit",
        "high": "High", "medium": "Medium", "low": "Low", "overview": "Document Overview", "metric": "Metric",
        "value": "Value", "pages": "Pages", "words": "Words", "headings": "Headings", "references": "References",
        "issues": "Issues", "rule": "Rule", "evidence": "Evidence", "recommendation": "Recommendation",
        "auto_fixable": "Auto-fixable", "critical": "Critical", "paragraphs": "Paragraphs", "tables": "Tables",
        "figures": "Figures", "generated": "Generated by the document review",
    },
    "vi": {
        "title": "Báo cáo Chất lượng", "profile": "Hồ sơ", "overall": "Điểm tổng thể", "status": "Trạng thái",
        "breakdown": "Phân tích điểm", "category": "Nhóm", "score": "Điểm", "grade": "Xếp loại",
        "excellent": "Xuất sắc", "good": "Tốt", "needs_work": "Cần cải thiện", "summary": "Tóm tắt vấn đề",
        "severity": "Mức độ", "count": "Số lượng", "autofixable": "Có thể tự sửa",
        "autofix_sentence": "Có thể tự động sửa {count} vấn đề.",
        "no_issues": "Không phát hiện vấn đề. Tài liệu đáp ứng các tiêu chuẩn chất lượng.",
        "draft": "Bản nháp", "review_needed": "Cần xem lại", "almost_ready": "Gần sẵn sàng", "ready": "Sẵn sàng gửi",
        "high": "Cao", "medium": "Trung bình", "low": "Thấp", "overview": "Tổng quan tài liệu", "metric": "Chỉ số",
        "value": "Giá trị", "pages": "Trang", "words": "Từ", "headings": "Tiêu đề", "references": "Tài liệu tham khảo",
        "issues": "Chi tiết vấn đề", "rule": "Quy tắc", "evidence": "Bằng chứng", "recommendation": "Khuyến nghị",
        "auto_fixable": "Có thể tự sửa", "critical": "Nghiêm trọng", "paragraphs": "Đoạn", "tables": "Bảng",
        "figures": "Hình", "generated": "Tạo bởi hệ thống đánh giá tài liệu",
    },
}
READY_ICONS = {"draft": "🟥", "review_needed": "🟧", "almost_ready": "🟨", "ready": "🟩"}


def report(scored: DataFrame, language: str = "en") -> DataFrame:
    """One Markdown text per document: header, overview, category scores with grade, severity counts, issues, footer.

    Columns ``tables`` and ``figures``, where the rows have them, fill their lines of the overview.
    """
    t = LABELS.get(language, LABELS["en"])
    ready = F.create_map(*[F.lit(x) for k in ("draft", "review_needed", "almost_ready", "ready") for x in (k, f"{READY_ICONS[k]} {t[k]}")])

    def score_line(e: Column) -> Column:
        grade = F.when(e["value"] >= 80, F.lit(f"🟢 {t['excellent']}")).when(e["value"] >= 65, F.lit(f"🟡 {t['good']}")).otherwise(
            F.lit(f"🔴 {t['needs_work']}"))
        return F.concat(F.lit("| "), F.initcap(e["key"]), F.lit(" | "), e["value"].cast("string"), F.lit("/100 | "), grade, F.lit(" |"))

    def severity_line(name: str, icon: str) -> Column:
        n = F.size(F.filter("issues", lambda i: i["severity"] == name))
        return F.when(n > 0, F.concat(F.lit(f"| {icon} {t[name]} | "), n.cast("string"), F.lit(" |")))

    severities = F.create_map(*[F.lit(x) for k in ("critical", "high", "medium", "low") for x in (k, t[k])])
    icons = F.create_map(*[F.lit(x) for pair in (("critical", "🔴"), ("high", "🟠"), ("medium", "🟡"), ("low", "🔵")) for x in pair])

    def issue_text(i: Column) -> Column:
        badge = F.when(i["fix"], F.lit(f" 🔧 {t['auto_fixable']}")).otherwise(F.lit(""))
        evidence = text_of(i, "excerpt")
        return F.concat(
            F.lit("#### "), icons[i["severity"]], F.lit(" "), text_of(i, "message"), badge,
            F.lit(f"\n- **{t['rule']}:** `"), text_of(i, "rule_id"), F.lit(f"`\n- **{t['severity']}:** "), severities[i["severity"]],
            F.when(evidence != "", F.concat(F.lit(f"\n- **{t['evidence']}:** _"), F.left(evidence, F.lit(200)), F.lit("_"))).otherwise(F.lit("")),
            F.lit(f"\n- **{t['recommendation']}:** "), text_of(i, "recommendation"), F.lit("\n"))

    def issue_list(found: Column) -> Column:
        categories = F.array_sort(F.array_distinct(F.transform(found, lambda i: i["category"])))
        return F.array_join(F.transform(categories, lambda c: F.concat(
            F.lit("### "), F.initcap(c), F.lit("\n\n"),
            F.array_join(F.transform(F.filter(found, lambda i: i["category"] == c), issue_text), "\n"))), "\n")

    words = rx.word_count(F.col("text"))
    paragraphs = F.size(F.filter(F.split("text", "\n\n", -1), lambda p: rx.strip(p) != ""))
    figures = [("pages", F.greatest(F.lit(1), F.floor(words / 300).cast("int"))), ("words", words), ("paragraphs", paragraphs),
               ("headings", F.size("headings")), *[(c, F.col(c)) for c in ("tables", "figures") if c in scored.columns], ("references", F.size("refs"))]
    overview = F.concat(
        F.lit(f"\n## {t['overview']}\n\n| {t['metric']} | {t['value']} |\n|---|---:|"),
        *[x for name, n in figures for x in (F.lit(f"\n| {t[name]} | "), n.cast("string"), F.lit(" |"))])

    before, after = t["autofix_sentence"].split("{count}")
    parts = [
        F.lit(f"# {t['title']}\n"), F.concat(F.lit(f"**{t['profile']}:** "), F.col("profile_id")),
        F.concat(F.lit(f"**{t['overall']}:** "), F.col("score").cast("string"), F.lit("/100")),
        F.concat(F.lit(f"**{t['status']}:** "), ready[F.col("readiness")]),
        overview,
        F.lit(f"\n## {t['breakdown']}\n\n| {t['category']} | {t['score']} | {t['grade']} |\n|---|---:|---|"),
        F.array_join(F.transform(F.map_entries("category_scores"), score_line), "\n"),
        F.lit(f"\n## {t['summary']}\n\n| {t['severity']} | {t['count']} |\n|---|---:|"),
        F.when(F.size("issues") > 0, F.array_join(F.array_compact(F.array(
            severity_line("critical", "🔴"), severity_line("high", "🟠"), severity_line("medium", "🟡"), severity_line("low", "🔵"))), "\n")).otherwise(
            F.lit(f"✅ {t['no_issues']}")),
        F.concat(F.lit(f"\n**{t['autofixable']}:** {before}"), F.col("n_fixable").cast("string"), F.lit(after)),
        F.when(F.size("issues") > 0, F.concat(
            F.lit(f"\n## {t['issues']}\n\n"), rx.let(F.col("issues"), issue_list))).otherwise(F.lit("")),
        F.lit(f"---\n_{t['generated']}_"),
    ]
    return scored.select("doc_id", F.array_join(F.array(*parts), "\n").alias("report"))
