"""Patterns, word lists and constants of the audit.

Fixed values: results depend on each of them. Groups are numbered; flags are given where a pattern is used.
"""

LABEL = r"([a-zA-Z][a-zA-Z0-9 _\-]{1,40}?)\s+"
#: where no match of a pattern that begins with LABEL starts: none does in the rest of a run that ends within a label's length
NO_LABEL = r"[a-zA-Z][a-zA-Z0-9 _\-]{0,40}+(?![a-zA-Z0-9 _\-])"
NUMERIC = LABEL + r"(?:is|was|are|=|:|of|at|to|equals?)\s+(\d[\d,\.]*\s*(?:ms|s|GB|MB|TB|KB|%|k|M|B|million|billion|thousand|USD|EUR|GBP|days?|weeks?|months?|years?|hours?|minutes?)?\b)"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE = (
    LABEL
    + r"(?:is|was|are|=|:|on|at|by|deadline|due|scheduled)\s+(\d{4}-\d{2}-\d{2}|Q[1-4]\s+\d{4}|"
    + MONTH
    + r"[a-z]*\.?\s+\d{1,2},?\s+\d{4}|"
    + MONTH
    + r"[a-z]*\.?\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4})"
)
MONEY = LABEL + r"(?:is|was|are|=|:|of|at|budget)\s+((?:USD|EUR|GBP|£|€|\$)\s*[\d,\.]+\s*(?:k|M|B|million|billion|thousand)?|[\d,\.]+\s*(?:k|M|B|million|billion|thousand)\s*(?:USD|EUR|GBP|dollars?|euros?|pounds?)?)"
SUBJECT = r"\b(?:system|service|application|platform|component)\b.{0,60}?"
DUTY = r"\s+([a-zA-Z]{2,20})\s+([a-zA-Z][a-zA-Z0-9 \-]{2,40})"
POSITIVE = SUBJECT + r"\b(?:shall|must|will)\b" + DUTY
NEGATIVE = SUBJECT + r"\b(?:shall not|must not|will not|cannot|should not)\b" + DUTY
GENERIC_LABELS = ["the", "a", "an", "it", "this", "that"]

#: phrase, category, severity, recommendation; the phrase is searched as a whole word
AMBIGUITY_RULES = [
    ("soon", "Vagueness", "medium", "Define a specific date or deadline (e.g. 'within 10 business days') instead of the vague 'soon'."),
    ("promptly", "Vagueness", "medium", "Specify a precise turnaround time (e.g., 'within 24 hours') instead of 'promptly'."),
    ("quickly", "Vagueness", "low", "Quantify the duration or performance metric instead of 'quickly'."),
    ("as needed", "Vagueness", "low", "Specify the exact triggering conditions or criteria for what is needed."),
    ("reasonable", "Subjectivity", "low", "Define the objective standard or metrics that define 'reasonable'."),
    ("appropriate", "Subjectivity", "low", "State the standard, policy, or role responsible for determining what is 'appropriate'."),
    ("sufficient", "Subjectivity", "low", "Specify the quantitative threshold that qualifies as 'sufficient'."),
    ("may", "Permissiveness", "medium", "State if this is purely optional, or use 'shall' / 'must' if it is a mandatory obligation."),
    ("should", "Permissiveness", "medium", "Use 'shall' or 'must' to establish a requirement, or clearly label this as a recommendation."),
    ("if necessary", "Conditional", "low", "Explicitly define the scenarios under which this action is necessary."),
    ("where applicable", "Conditional", "low", "Detail the specific scope or sections where this clause applies."),
    ("typically", "Generalization", "low", "Clearly state the rule and describe any known exceptions instead of using 'typically'."),
    ("normally", "Generalization", "low", "Specify the normal operating conditions or criteria."),
]
MOST_AMBIGUITIES = 50

REFERENCES = {
    "section": r"\b(?:Section|Sec\.)\s*(\d+(?:\.\d+)*)\b",
    "clause": r"\bClause\s*(\d+(?:\.\d+)*)\b",
    "appendix": r"\bAppendix\s*([A-Z\d]+)\b",
    "figure": r"\b(?:Figure|Fig\.)\s*(\d+)\b",
    "table": r"\bTable\s*(\d+)\b",
    "requirement": r"\b(?:REQ|Requirement)\s*[- ]*(\d+)\b",
}
#: kind, flags, pattern of a definition
DEFINITIONS = [
    ("section", "im", r"^\s*(?:Section|Sec\.)\s*(\d+(?:\.\d+)*)"),
    ("section", "m", r"^\s*(\d+\.\d+(?:\.\d+)*)\s+[A-Z]"),
    ("clause", "im", r"^\s*Clause\s*(\d+(?:\.\d+)*)"),
    ("appendix", "im", r"^\s*Appendix\s*([A-Z\d]+)"),
    ("figure", "i", r"\b(?:Figure|Fig\.)\s*(\d+)\b\s*[:\-]"),
    ("table", "i", r"\bTable\s*(\d+)\b\s*[:\-]"),
    ("requirement", "i", r"\b(?:REQ|Requirement)\s*[- ]*(\d+)\b\s*[:\-]"),
    ("requirement", "im", r"^\s*(?:REQ|Requirement)\s*[- ]*(\d+)\b"),
]
REQUIREMENT = r"\b(?:REQ|Requirement|Functional Requirement)\s*[- ]*(\d+)\b"
PLACEHOLDER = r"\b(?:TODO|TBD|__+|\[insert[^\]]*\])\b"
SNIPPET_MONEY = r"\$\s*[\d,]+(?:\.\d+)?\s*(?:M|B|K|million|billion|thousand)?"
SNIPPET_DATE = r"\b" + MONTH + r"[a-z]* \d{1,2}, \d{4}|\b\d{1,2}/\d{1,2}/\d{2,4}\b"

#: points by component and severity or status
CONFLICT_POINTS = {"critical": 20.0, "high": 12.0, "medium": 6.0, "low": 2.0}
REFERENCE_POINTS = 8.0
REQUIREMENT_POINTS = {"MISSING": 12.0, "ORPHANED": 4.0}
ENTITY_POINTS = {"critical": 15.0, "high": 15.0, "medium": 8.0, "low": 3.0}
AMBIGUITY_POINTS = {"high": 8.0, "medium": 4.0, "low": 1.5}
PLACEHOLDER_POINTS = 8.0
#: component, column, weight
COMPONENTS = [
    ("Contradiction Health", "contradiction_health", 0.35),
    ("Reference Integrity", "reference_integrity", 0.20),
    ("Requirement Traceability", "requirement_traceability", 0.15),
    ("Entity Consistency", "entity_consistency", 0.15),
    ("Ambiguity Analysis", "ambiguity_analysis", 0.10),
    ("Document Completeness", "document_completeness", 0.05),
]

QUOTES, PLAIN_QUOTES = "“”‘’–—", "\"\"''--"
ARTEFACT_LINES = [r"^\s*page\s+\d+\s+of\s+\d+\s*$", r"^\s*-\s*\d+\s*-\s*$", r"^\s*\[\s*page\s+\d+\s*\]\s*$", r"^\s*page\s+\d+\s*$"]
WORD_TOKEN = r"\b[a-zA-Z0-9_'-]{2,}\b"
STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "is", "are", "of", "that", "this"]
