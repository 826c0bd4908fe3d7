"""Every issue a rule can raise, and the rule catalogue.

``{name}`` in a text is filled from the finding. ISSUES maps a short key to
(issue id, rule id, severity, confidence, source, message, recommendation, excerpt, location).
"""

SYN, SEM, CROSS = "syntax-rule", "semantic-rule", "cross-rule"
LINE, DOC = "line {line}", "document"

# --- fixed values: issues --------------------------------------------------------
ISSUES = {
    # structure
    "no-title": ("structure.no-title", "structure.title-check", "high", 100, SYN,
        "Document has no title or headings.", "Add a title as an H1 heading at the beginning of the document.",
        "No headings found", DOC),
    "title-not-h1": ("structure.title-not-h1", "structure.title-check", "medium", 100, SYN,
        "First heading is H{level}, not H1.", "Use H1 for the document title.",
        "First heading: H{level} '{title}'", LINE),
    "abstract-too-short": ("structure.abstract-too-short", "structure.abstract-check", "medium", 90, SEM,
        "Abstract/Summary is too short ({words} words, min: {limit}).",
        "Expand the abstract to adequately summarize the document.", "Abstract has {words} words", LINE),
    "abstract-too-long": ("structure.abstract-too-long", "structure.abstract-check", "low", 85, SEM,
        "Abstract/Summary is too long ({words} words, max: {limit}).", "Consider condensing the abstract.",
        "Abstract has {words} words", LINE),
    "missing-abstract": ("structure.missing-abstract", "structure.abstract-check", "high", 100, SYN,
        "Missing abstract/executive summary (required for {profile} documents).",
        "Add a concise abstract (academic) or executive summary (business).",
        "No abstract or executive summary heading found", DOC),
    "missing-key-section": ("structure.missing-{key}", "structure.key-sections-check", "{severity}", 95, CROSS,
        "Missing key section: '{display}'.", "Add a '{display}' section to ensure completeness.",
        "Required section '{display}' not found", DOC),
    "wrong-order": ("structure.wrong-order-{key}", "structure.section-order", "medium", 85, CROSS,
        "Section '{current}' appears before '{previous}'.",
        "Reorder sections: '{previous}' should come before '{current}'.",
        "'{current}' at line {current_line}, '{previous}' at line {previous_line}",
        "lines {previous_line}-{current_line}"),
    "empty-section": ("structure.empty-section-{index}", "structure.empty-section", "medium", 95, SEM,
        "Section '{title}' is nearly empty ({words} words).",
        "Add content to the '{title}' section or remove it if not needed.", "'{title}' has only {words} words",
        "section starting at line {line}"),
    "duplicate-section": ("structure.duplicate-section-{slug}", "structure.duplicate-section", "medium", 100, SYN,
        "Duplicate section heading: '{title}' found {count} times.", "Rename or merge the duplicate sections.",
        "'{title}' at lines: {all_lines}", "lines {line}, {last_line}"),
    "section-too-large": ("structure.section-too-large-{slug}", "structure.section-length-variance", "low", 70, SEM,
        "Section '{title}' is {words} words — {ratio}x the average ({average}).",
        "Consider splitting into sub-sections or condensing.", "'{title}': {words} words", "section '{title}'"),
    "keywords-empty": ("structure.keywords-empty", "structure.keywords-check", "low", 100, SYN,
        "Keywords section is empty.", "Add 4-6 keywords that represent the main topics of your paper.",
        "Empty keywords section", LINE),
    "missing-keywords": ("structure.missing-keywords", "structure.keywords-check", "low", 90, SYN,
        "No 'Keywords' section found (recommended for academic papers).",
        "Add a 'Keywords' section after the abstract with 4-6 key terms.", "Keywords section not found", DOC),
    "sop-missing": ("structure.sop-missing-{key}", "structure.sop-required-fields", "high", 100, CROSS,
        "Missing required SOP section: '{display}'.", "SOP documents must include a '{display}' section.",
        "Required SOP section '{display}' not found", DOC),
    "required-section": ("structure-missing-{slug}", "structure.required-section", "high", 100, SYN,
        "Missing required section: {section}.", "Add a clear '{section}' section.", "No matching heading found.",
        DOC),
    "heading-gap": ("structure-heading-gap-{level}", "structure.heading-hierarchy", "medium", 100, SYN,
        "Heading levels skip a hierarchy level.", "Use consecutive heading levels (for example, H2 then H3).",
        "Heading hierarchy jump", "headings"),
    # writing
    "grammar": ("writing.grammar-{line}", "writing.grammar", "medium", 80, SYN, "{problem}: '{match}'",
        "Check grammar at line {line}: {problem}.", "{excerpt}", LINE),
    "spelling": ("writing.spelling-{line}-{word}", "writing.spelling", "low", 95, SYN,
        "Spelling error: '{word}' should be '{correction}'.", "Replace '{word}' with '{correction}'.", "{excerpt}",
        LINE),
    "punctuation": ("writing.punctuation-{line}", "writing.punctuation", "low", 90, SYN, "{problem} (line {line})",
        "Fix punctuation at line {line}: {problem}.", "{excerpt}", LINE),
    "readability-complex": ("writing.readability-complex", "writing.readability", "low", 80, SEM,
        "Document contains {count} long words ({percent}% of total).",
        "Consider using shorter, more common words to improve readability.",
        "{percent}% long words (max: {limit}%)", DOC),
    "readability-long-sentences": ("writing.readability-long-sentences", "writing.readability", "low", 85, SEM,
        "Average sentence length is {average} words (recommended: <= {limit}).",
        "Break down long sentences to improve readability.", "Avg {average} words/sentence (max: {limit})", DOC),
    "overused": ("writing.overused-{line}", "writing.overused-phrases", "low", 85, SEM,
        "Overused phrase detected on line {line}.", "{advice}", "{excerpt}", LINE),
    "terminology": ("writing.terminology-{slug}", "writing.terminology", "low", 90, CROSS,
        "Inconsistent terminology: '{first}' ({n_first}x) and '{second}' ({n_second}x).",
        "Use '{dominant}' consistently instead of '{other}'.", "'{first}': {n_first}, '{second}': {n_second}", DOC),
    "passive": ("writing.passive-{line}", "writing.passive-voice", "low", 85, SEM,
        "Passive voice detected. Consider using active voice.",
        "Consider rewriting: '{context}...' in active voice.", "{excerpt}", LINE),
    "hedging": ("writing.hedging-{line}", "writing.hedging", "low", 75, SEM,
        "Cautionary word '{match}' weakens the statement.",
        "Use more confident language or provide evidence for the claim.", "{excerpt}", LINE),
    "weak": ("writing.weak-{line}", "writing.weak-wording", "low", 70, SEM,
        "Weak word: '{match}'. Use more precise language.", "Replace '{match}' with a more specific term.",
        "{excerpt}", LINE),
    "verbose": ("writing.verbose-{line}", "writing.verbosity", "low", 90, SYN, "Verbose phrase detected.",
        "{advice}", "{excerpt}", LINE),
    "contraction": ("writing.contraction-{line}", "writing.contractions", "low", 95, SYN,
        "Contraction '{match}' used. Avoid contractions in {profile} writing.",
        "Replace '{match}' with its full form.", "{excerpt}", LINE),
    "long-sentence": ("writing.long-sentence-{line}", "writing.sentence-length", "low", 88, SEM,
        "Sentence has {words} words (recommended max: {limit}).",
        "Split into shorter sentences for better readability.", "{excerpt}", LINE),
    "long-line": ("writing-long-sentence-{line}", "writing.sentence-length", "low", 92, SEM,
        "This sentence is hard to scan because it is very long.",
        "Split it into shorter sentences while preserving the meaning.", "{excerpt}", LINE),
    "repetition": ("writing.repetition-{word}", "writing.repetition", "low", 85, SEM,
        "Transition word '{word}' used {count} times.",
        "Vary transitions: use synonyms like 'in contrast', 'as a result', 'in addition', etc.",
        "'{word}' appears {count} times", DOC),
    "informal": ("writing.informal-{line}", "writing.tone-consistency", "medium", 95, SYN,
        "Informal language '{word}' found. Use formal academic tone.", "Replace '{word}' with a formal equivalent.",
        "{excerpt}", LINE),
    "business-passive": ("writing.business-passive", "writing.tone-consistency", "medium", 75, SEM,
        "Excessive passive voice for a business proposal.",
        "Use active, persuasive language to engage the reader.", "{count} passive constructions found", DOC),
    "sop-imperative": ("writing.sop-imperative", "writing.tone-consistency", "medium", 70, SEM,
        "SOP should use imperative mood for procedures.",
        "Use clear, direct commands (e.g., 'Open the valve' instead of 'The valve should be opened').",
        "Few imperative sentences detected", DOC),
    # citation
    "missing-reference-list": ("citation.missing-reference-list", "citation.in-text-reference-mismatch", "high", 96,
        CROSS, "Found {count} in-text citation(s) but no reference list.",
        "Add a 'References' or 'Bibliography' section with complete entries.", "{count} citation(s) detected", DOC),
    "orphan-references": ("citation.orphan-references", "citation.in-text-reference-mismatch", "medium", 85, CROSS,
        "Found {count} reference(s) but no in-text citations.",
        "Ensure every reference is cited in the document body.", "{excerpt}", "references"),
    "invalid-year": ("citation.invalid-year-{year}", "citation.year-validity", "low", 90, SYN,
        "Citation uses year '{year}', which is outside valid range (1900-2026).",
        "Verify the publication year is correct.", "Year {year}", DOC),
    "future-year": ("citation.future-year-{year}", "citation.year-validity", "low", 70, SYN,
        "Citation uses year '{year}', which may be a future or in-press publication.",
        "Verify the date. For in-press works, use 'in press' or the expected year.", "Year {year}", DOC),
    "apa-format": ("citation.apa-format-{line}", "citation.apa-format", "low", 70, SEM,
        "Possible citation at line {line} does not match APA 7 format.",
        "Use APA 7 format: (Author, Year) or Author (Year).", "{excerpt}", LINE),
    "apa-no-heading": ("citation.apa-no-heading", "citation.apa-heading", "medium", 95, SYN,
        "Reference entries found but no 'References' heading.",
        "Add a 'References' heading (APA 7 uses bold, centered H1/H2).", "{count} reference(s) without heading",
        "references"),
    "ieee-start": ("citation.ieee-start", "citation.ieee-format", "low", 80, SYN,
        "IEEE citations should start from [1].", "Ensure the first reference cited is [1].", "Starts from [{number}]",
        DOC),
    "ieee-order": ("citation.ieee-order", "citation.ieee-format", "medium", 85, CROSS,
        "IEEE citations are not in sequential order.",
        "IEEE requires references to be numbered in order of first appearance.",
        "First instances of citations: [{numbers}]", DOC),
    "doi-empty": ("citation.doi-empty", "citation.doi-validation", "low", 100, SYN,
        "DOI URL is missing the identifier.", "Provide the full DOI identifier (e.g., doi.org/10.1000/xyz123).",
        "{excerpt}", DOC),
    "broken-url": ("citation.broken-url", "citation.doi-validation", "low", 85, SYN,
        "URL appears malformed: '{short}...'", "Verify the URL is complete and accessible.", "{excerpt}", DOC),
    "acm-start": ("citation.acm-start", "citation.acm-format", "low", 75, SYN,
        "ACM citations should typically start from [1].", "Ensure the first reference cited is [1] in ACM style.",
        "First citation number: [{number}]", DOC),
    "acm-reference": ("citation.acm-ref-format-{index}", "citation.acm-reference-format", "low", 70, SEM,
        "Reference may not follow ACM format (initials before surname).",
        "ACM format: J. K. Author, 'Title,' Publisher, Year.", "{excerpt}", "reference {position}"),
    "nature-start": ("citation.nature-start", "citation.nature-format", "low", 75, SYN,
        "Nature superscript citations should start from ¹.", "Ensure first citation is numbered 1.",
        "First citation number: {number}", DOC),
    "springer-no-refs": ("citation.springer-no-refs", "citation.springer-format", "high", 90, CROSS,
        "Found {count} Springer-style citations but no reference list.",
        "Add a complete reference list formatted per Springer guidelines.", "{count} citations without references",
        DOC),
    "elsevier-start": ("citation.elsevier-start", "citation.elsevier-format", "low", 80, SYN,
        "Elsevier citations should start from [1].", "Ensure the first reference is [1].", "Starts from [{number}]",
        DOC),
    "mixed-styles": ("citation.mixed-styles", "citation.style-consistency", "medium", 90, CROSS,
        "Mixed citation styles detected: {styles}.",
        "Use only one citation style consistently throughout the document.", "Styles: {styles}", DOC),
    "duplicate-ref": ("citation.duplicate-ref-{index}", "citation.duplicate-reference", "low", 80, SYN,
        "Possible duplicate reference entry.", "Remove the duplicate reference entry.", "{excerpt}",
        "reference {position}"),
    "list-missing": ("citation-missing-reference-list", "citation.reference-list", "high", 96, CROSS,
        "In-text citations were found but no reference list was detected.",
        "Add a References or Bibliography heading and complete entries.", "Citation markers detected", DOC),
    "list-orphan": ("citation-orphan-reference-list", "citation.in-text-match", "medium", 78, CROSS,
        "A reference list was found but no in-text citation pattern was detected.",
        "Verify that every cited source is referenced in the body.", "{excerpt}", "references"),
    # format
    "mixed-numbering": ("format.mixed-numbering", "format.heading-numbering", "medium", 95, SYN,
        "Headings use mixed numbering styles (numbered, unnumbered, roman).",
        "Choose one numbering style and apply consistently across all headings.",
        "{numbered} numbered, {unnumbered} unnumbered, {roman} roman headings", "headings"),
    "heading-skip": ("format.heading-skip-{index}", "format.heading-hierarchy-deep", "medium", 100, SYN,
        "Heading level jumps from H{upper} to H{lower}.", "Use H{wanted} instead of H{lower} for the sub-heading.",
        "Heading level {upper} → {lower} at heading index {position}", "headings"),
    "heading-too-deep": ("format.heading-too-deep", "format.heading-hierarchy-deep", "low", 80, SYN,
        "Document uses up to H{level}, which may be too deep.",
        "Consider restructuring to keep headings within H1-H4.", "Maximum heading depth: H{level}", "headings"),
    "first-heading-not-h1": ("format.first-heading-not-h1", "format.heading-hierarchy-deep", "low", 95, SYN,
        "The first heading is not H1.", "Start with an H1 heading for the main title.", "First heading is H{level}",
        "headings"),
    "missing-section": ("format.missing-section-{slug}", "format.required-sections-depth", "high", 100, SYN,
        "Missing required section: '{section}'.", "Add a clear '{section}' section heading (H1 or H2).",
        "Required section '{section}' not found in headings", "headings"),
    "short-section": ("format.short-section-{index}", "format.section-length", "low", 85, SEM,
        "Section '{title}' is very short ({words} words).",
        "Consider expanding the section or merging it with another section.",
        "'{title}' has {words} words (min: {limit})", LINE),
    "long-section": ("format.long-section-{index}", "format.section-length", "low", 80, SEM,
        "Section '{title}' is very long ({words} words).", "Consider splitting into sub-sections.",
        "'{title}' has {words} words (max: {limit})", LINE),
    "heading-font": ("format.heading-font-mismatch", "format.block-format", "low", 90, SYN,
        "Headings use different fonts.", "Use the same font for all headings.", "Found fonts: {fonts}", "blocks"),
    "mixed-alignment": ("format.mixed-alignment", "format.block-format", "low", 75, SEM,
        "Document uses multiple text alignments inconsistently.",
        "Stick to one alignment (usually 'justify' or 'left').", "Alignments found: {alignments}", "blocks"),
    # figures and tables
    "figure-gap": ("figure.numbering-gap-{number}", "figure.numbering-sequential", "medium", 85, SYN,
        "Figure numbering gap or skip: found Figure {number}, expected Figure {expected}.",
        "Renumber figures sequentially (Figure 1, 2, 3...).", "Expected Figure {expected}, found Figure {number}",
        DOC),
    "table-gap": ("figure.table-gap-{number}", "figure.table-numbering", "medium", 85, SYN,
        "Table numbering gap: found Table {number}, expected Table {expected}.",
        "Renumber tables sequentially (Table 1, 2, 3...).", "Expected Table {expected}, found Table {number}", DOC),
    "missing-caption": ("figure.missing-caption-{node}", "figure.missing-caption", "high", 100, SYN,
        "Figure is missing a caption.", "Add a caption to the figure (e.g., 'Figure 1: Description').",
        "Figure without caption", "block {node}"),
    "placeholder": ("figure.placeholder-{line}", "figure.missing-caption", "medium", 90, SEM,
        "Figure placeholder detected without actual content.", "Replace with the actual figure and add a caption.",
        "{excerpt}", LINE),
    "missing-table-caption": ("figure.missing-table-caption-{node}", "figure.missing-table-caption", "high", 100,
        SYN, "Table is missing a caption.", "Add a caption to the table (e.g., 'Table 1: Description').",
        "Table without caption", "block {node}"),
    "figure-ref": ("figure.ref-mismatch-{number}", "figure.cross-reference", "medium", 85, CROSS,
        "Cross-reference to Figure {number} but no such figure exists.",
        "Verify the figure number or add Figure {number}.", "{excerpt}", LINE),
    "table-ref": ("figure.table-ref-mismatch-{number}", "figure.cross-reference", "medium", 85, CROSS,
        "Cross-reference to Table {number} but no such table exists.",
        "Verify the table number or add Table {number}.", "{excerpt}", LINE),
    "figure-unused": ("figure.not-referenced-{number}", "figure.cross-reference", "low", 90, CROSS,
        "Figure {number} exists but is not referenced in the text.",
        "Add a cross-reference to Figure {number} in the body text.", "Figure {number} not referenced in text", DOC),
    "caption-empty": ("figure.caption-empty-{line}", "figure.caption-format", "medium", 100, SYN,
        "{prefix} has no descriptive text.", "Add a descriptive caption after the number.", "{excerpt}", LINE),
    "caption-period": ("figure.caption-period-{line}", "figure.caption-format", "low", 75, SYN,
        "{prefix} caption should end with a period.", "End captions with a period.", "{excerpt}", LINE),
    "caption-long": ("figure.caption-long-{line}", "figure.caption-format", "low", 80, SEM,
        "Caption is too long ({chars} chars).", "Keep captions concise (under 300 characters).", "{excerpt}", LINE),
    "figures-missing": ("figure.cited-missing-all", "figure.cited-missing", "high", 95, CROSS,
        "{count} figure reference(s) found but no actual figures in the document.",
        "Add the referenced figures or remove the references.", "{count} figure references detected without figures",
        DOC),
    "tables-missing": ("figure.table-cited-missing-all", "figure.table-cited-missing", "high", 95, CROSS,
        "{count} table reference(s) found but no actual tables in the document.",
        "Add the referenced tables or remove the references.", "{count} table references without tables", DOC),
    "equations": ("figure.equations-not-numbered", "figure.equation-numbering", "low", 75, SEM,
        "{count} equation(s) found but none are numbered.",
        "Number equations sequentially (1), (2), (3)... for easy cross-referencing.",
        "{count} unnumbered equations", DOC),
    # logic
    "acronym": ("logic.undefined-acronym-{acronym}", "logic.undefined-acronym", "medium", 85, CROSS,
        "Acronym '{acronym}' used without being defined (line {line}).",
        "Define '{acronym}' on first use: '... (acronym)'.", "{excerpt}", LINE),
    "transition": ("logic.missing-transition-{index}", "logic.missing-transition", "low", 60, SEM,
        "Paragraph may need a transition from the previous one.",
        "Start with a transition word (e.g., 'However', 'Therefore', 'Furthermore') or a bridging sentence.",
        "{excerpt}", "paragraph {position}"),
    "duplicate": ("logic.duplicate-{line}", "logic.duplicate-content", "medium", 75, SEM,
        "Possible duplicate content detected.", "Review and remove or rephrase the duplicate content.", "{excerpt}",
        LINE),
    "scope": ("logic.scope-new-term-{term_lower}", "logic.scope-mismatch", "low", 65, SEM,
        "Term '{term}' appears in conclusion but not in the main body.",
        "Ensure all key terms introduced in the conclusion are discussed earlier.",
        "'{term}' found only in conclusion section", "conclusion"),
    "contradiction": ("logic.contradiction-abs-qual-{index}", "logic.contradictions", "high", 60, SEM,
        "Possible contradiction: uses absolutist language and qualifiers in the same section.",
        "Ensure statements are consistent: either absolute (all, none) or qualified (some, most), not both.",
        "{excerpt}", LINE),
    "contrast-mix": ("logic.contradiction-mix-{line}", "logic.contradictions", "medium", 55, SEM,
        "Mixed contrast and similarity markers near each other.",
        "Choose one logical relationship: use contrast OR similarity markers, not both in the same argument.",
        "{excerpt}", LINE),
    "claim": ("logic.claim-{line}", "logic.claim-without-evidence", "medium", 65, SEM,
        "Strong claim on line {line} lacks supporting citation or evidence.",
        "Support strong claims with a citation, data reference, or experimental evidence.", "{excerpt}", LINE),
    "unsupported": ("logic.unsupported-conclusion-terms", "logic.unsupported-conclusion", "medium", 70, SEM,
        "Conclusion introduces {count} term(s) not discussed in the main body.",
        "Ensure the conclusion only references concepts and results already presented in the body.",
        "Terms not in body: {terms}", "conclusion"),
    "date-formats": ("logic.inconsistent-date-formats", "logic.number-consistency", "low", 90, SYN,
        "Inconsistent date formats: {formats}", "Use a single date format consistently throughout the document.",
        "Multiple date formats found", DOC),
    "mixed-numbers": ("logic.mixed-number-formats-{line}", "logic.number-consistency", "low", 80, SYN,
        "Mixed word and digit number formats on line {line}.",
        "Be consistent: use words for small numbers (one-nine) and digits for 10+.", "{excerpt}", LINE),
    # compliance
    "no-safety": ("compliance.no-safety-content", "compliance.safety-warning", "high", 95, SEM,
        "No safety warnings or safety section detected in SOP document.",
        "Add a 'Safety' or 'Warnings' section with relevant hazard information, required PPE, and emergency "
        "procedures.", "No safety keywords found", DOC),
    "little-safety": ("compliance.insufficient-safety", "compliance.safety-warning", "medium", 80, SEM,
        "Insufficient safety content (score: {score}). Add dedicated safety section.",
        "Create a dedicated 'Safety Warnings' section listing all hazards and precautions.",
        "Safety score: {score}", DOC),
    "no-signature": ("compliance.missing-signatures", "compliance.signatures", "high", 95, SYN,
        "Missing approval/signature section for SOP document.",
        "Add an 'Approval' section with: Prepared by, Reviewed by, Approved by, and dates.",
        "No signature or approval content found", DOC),
    "no-date": ("compliance.missing-date", "compliance.signatures", "low", 85, SYN,
        "No dates found in the document.",
        "Add effective date, review date, and approval dates for compliance tracking.", "No dates detected", DOC),
    "no-revision-history": ("compliance.missing-revision-history", "compliance.revision-history", "{severity}", 95,
        SYN, "Missing revision history section.",
        "Add a 'Revision History' table with: Version, Date, Description, Author.",
        "No revision history heading found", DOC),
    "no-version-number": ("compliance.no-version-number", "compliance.revision-history", "medium", 90, SYN,
        "No version number found in document.",
        "Add a version number (e.g., 'Version 1.0') in the header or revision history.",
        "No version pattern detected", DOC),
    "iso-missing": ("compliance.iso-missing-{slug}", "compliance.iso9001", "high", 90, CROSS,
        "Missing ISO 9001 required element: '{display}'.",
        "Add documentation for '{display}' as required by ISO 9001:2015 clause 7.5.",
        "ISO 9001 element '{display}' not found", DOC),
    "iso-doc-control": ("compliance.iso-doc-control", "compliance.iso9001", "medium", 85, CROSS,
        "Missing document control procedures (ISO 9001 clause 7.5.3).",
        "Add a section describing document approval, review, update, and version control procedures.",
        "No document control terms found", DOC),
    "fda-gxp": ("compliance.fda-gxp", "compliance.fda", "high", 85, CROSS,
        "No GxP/validation terms found (FDA-regulated documents).",
        "Include validation and GxP compliance documentation as per 21 CFR Part 820.", "No GxP terms detected", DOC),
    "fda-part11": ("compliance.fda-part11", "compliance.fda", "high", 80, CROSS,
        "Insufficient 21 CFR Part 11 elements (found {count}/7).",
        "Add documentation for: audit trail, electronic signature, data integrity, access control.",
        "Found {count}/7 FDA Part 11 elements", DOC),
    "who": ("compliance.who-structure", "compliance.who", "medium", 75, CROSS,
        "Document may not follow WHO structure guidelines (found {count}/7 elements).",
        "Follow WHO document structure: Objective, Scope, Responsibility, Procedure, Documentation, References.",
        "Found {count}/7 WHO-expected sections", DOC),
    "sop-no-imperative": ("compliance.sop-no-imperative", "compliance.sop-validation", "high", 90, CROSS,
        "SOP lacks imperative/obligation language (must, shall, ensure).",
        "Use 'must' and 'shall' to define mandatory actions in procedures.", "No obligation language detected", DOC),
    "sop-no-steps": ("compliance.sop-no-steps", "compliance.sop-validation", "medium", 85, SEM,
        "SOP procedure does not use numbered steps.",
        "Break down procedures into clear, numbered sequential steps.", "No numbered steps detected", DOC),
    "sop-regulatory": ("compliance.sop-regulatory", "compliance.sop-validation", "medium", 75, SEM,
        "Insufficient regulatory/compliance language in SOP (found {count} terms).",
        "Include compliance terms: 'shall', 'must', 'comply', 'requirement', 'standard'.",
        "Found {count} regulatory terms", DOC),
    "no-versioning": ("compliance.no-versioning", "compliance.versioning", "medium", 95, SYN,
        "No version numbering found in document.",
        "Add version number (e.g., 'Version 1.0') and include in revision history.", "No version number detected",
        DOC),
    "draft-version": ("compliance.draft-version", "compliance.versioning", "low", 90, SYN,
        "Document is version {version} (draft).", "Promote to Version 1.0 when finalized.",
        "Version {version} detected", DOC),
    "mandatory": ("compliance.mandatory-{pack}-{slug}", "compliance.mandatory-sections", "{severity}", 95, CROSS,
        "Missing mandatory section '{display}' required by {pack_upper} pack.",
        "Add a '{display}' section as required by {pack_upper} compliance standards.",
        "'{display}' not found in document", DOC),
    "no-warning": ("compliance-safety-warning", "compliance.safety-warning", "high", 88, SEM,
        "No safety warning was detected.",
        "Add an explicit safety warning where the procedure can create risk.", "No warning marker found.", DOC),
    # reference template
    "template-margin": ("template.layout.{key}", "template.layout.{key}", "medium", 95, "reference_template",
        "Page {side} margin is {actual} in; the reference template uses {expected} in.",
        "Set the {side} margin to {expected} in.", "Reference template comparison",
        "Document formatting and structure"),
    "template-font": ("template.body.font", "template.body.font", "medium", 95, "reference_template",
        "Body font is {actual}; the reference template uses {expected}.", "Apply {expected} to the Normal/body style.",
        "Reference template comparison", "Document formatting and structure"),
    "template-font-size": ("template.body.font_size", "template.body.font_size", "low", 95, "reference_template",
        "Body font size is {actual} pt; the reference template uses {expected} pt.",
        "Set the Normal/body style to {expected} pt.", "Reference template comparison",
        "Document formatting and structure"),
    "template-section": ("template.structure.missing_section", "template.structure.missing_section", "high", 95,
        "reference_template", 'Required section "{section}" from the reference template is missing.',
        'Add the "{section}" section using the corresponding heading style.', "Reference template comparison",
        "Document formatting and structure"),
}

# --- fixed values: rule catalogue -----------------------------------------------------
# rule id -> (category, priority, pack)
RULES = {
    "structure.title-check": ("structure", 50, ""), "structure.abstract-check": ("structure", 40, ""),
    "structure.key-sections-check": ("structure", 35, ""), "structure.section-order": ("structure", 30, ""),
    "structure.empty-section": ("structure", 25, ""), "structure.duplicate-section": ("structure", 20, ""),
    "structure.section-length-variance": ("structure", 15, ""), "structure.keywords-check": ("structure", 10, "apa"),
    "structure.sop-required-fields": ("structure", 35, "sop"), "structure.required-section": ("structure", 15, ""),
    "structure.heading-hierarchy": ("structure", 12, ""),
    "writing.grammar": ("writing", 28, ""), "writing.spelling": ("writing", 27, ""),
    "writing.punctuation": ("writing", 26, ""), "writing.passive-voice": ("writing", 25, ""),
    "writing.readability": ("writing", 23, ""), "writing.sentence-length": ("writing", 22, ""),
    "writing.terminology": ("writing", 20, ""), "writing.hedging": ("writing", 20, ""),
    "writing.weak-wording": ("writing", 18, ""), "writing.verbosity": ("writing", 15, ""),
    "writing.tone-consistency": ("writing", 15, ""), "writing.overused-phrases": ("writing", 14, ""),
    "writing.contractions": ("writing", 12, ""), "writing.repetition": ("writing", 10, ""),
    "citation.in-text-reference-mismatch": ("citation", 30, ""), "citation.reference-list": ("citation", 30, ""),
    "citation.style-consistency": ("citation", 30, ""), "citation.apa-format": ("citation", 25, "apa"),
    "citation.ieee-format": ("citation", 25, "ieee"), "citation.acm-format": ("citation", 25, "acm"),
    "citation.nature-format": ("citation", 25, "nature"), "citation.springer-format": ("citation", 25, "springer"),
    "citation.elsevier-format": ("citation", 25, "elsevier"), "citation.year-validity": ("citation", 20, ""),
    "citation.apa-heading": ("citation", 20, "apa"), "citation.acm-reference-format": ("citation", 20, "acm"),
    "citation.doi-validation": ("citation", 15, ""), "citation.duplicate-reference": ("citation", 10, ""),
    "format.required-sections-depth": ("format", 15, ""), "format.heading-numbering": ("format", 10, ""),
    "format.heading-hierarchy-deep": ("format", 8, ""), "format.section-length": ("format", 5, ""),
    "format.block-format": ("format", 3, ""),
    "figure.missing-caption": ("figure_table", 35, ""), "figure.missing-table-caption": ("figure_table", 35, ""),
    "figure.numbering-sequential": ("figure_table", 30, ""), "figure.table-numbering": ("figure_table", 30, ""),
    "figure.cited-missing": ("figure_table", 30, ""), "figure.table-cited-missing": ("figure_table", 30, ""),
    "figure.cross-reference": ("figure_table", 25, ""), "figure.caption-format": ("figure_table", 20, ""),
    "figure.equation-numbering": ("figure_table", 15, ""),
    "logic.undefined-acronym": ("logic", 30, ""), "logic.contradictions": ("logic", 25, ""),
    "logic.claim-without-evidence": ("logic", 22, ""), "logic.duplicate-content": ("logic", 20, ""),
    "logic.unsupported-conclusion": ("logic", 20, ""), "logic.missing-transition": ("logic", 15, ""),
    "logic.number-consistency": ("logic", 15, ""), "logic.scope-mismatch": ("logic", 10, ""),
    "compliance.sop-validation": ("compliance", 50, "sop"), "compliance.iso9001": ("compliance", 45, "iso9001"),
    "compliance.fda": ("compliance", 45, "fda"), "compliance.signatures": ("compliance", 40, ""),
    "compliance.who": ("compliance", 40, "who"), "compliance.mandatory-sections": ("compliance", 40, ""),
    "compliance.revision-history": ("compliance", 35, ""), "compliance.versioning": ("compliance", 25, ""),
    "compliance.safety-warning": ("compliance", 20, ""),
}

# --- fixed values: categories whose issues carry another name than their rule prefix ----
CATEGORY_OF_PREFIX = {"figure": "figure_table", "template": "formatting"}
