"""Default rules: subtypes of clause families with their guards, in order; the first match wins."""

# (family, subtype, pattern for the label, guard for the text or None for an umbrella)
SUBTYPES = [
    ("termination", "Termination for Cause", r"terminat.*cause", r"for cause|with cause"),
    ("termination", "Termination", r"terminat", None),
    ("payment", "Late Payment", r"late.*pay|pay.*late", r"late|overdue"),
    ("payment", "Fees", r"^fees?$", r"fee of"),
    ("payment", "Payment Terms", r"payment", r"payment for|interest of"),
    ("assignment", "Assignment", r"assign", r"assign"),
    ("notices", "Notices", r"notice", r"notice"),
    ("liability", "Liability Cap", r"liability", r"is capped at"),
    ("liability", "Indemnity", r"indemni", r"indemnif"),
    ("law", "Governing Law", r"governing.law", r"law of"),
    ("law", "Arbitration", r"arbitrat", r"arbitra"),
    ("ip", "Ip Ownership", r"ip.ownership", r"title to"),
    ("records", "Audit Rights", r"audit", r"audit"),
    ("records", "Confidentiality", r"confidential", r"confidential|disclose"),
]
# Heading patterns by clause type.
HEADINGS = {
    "termination": [r"termination", r"term and termination"],
    "assignment": [r"assignments?", r"successors and assigns"],
    "notices": [r"notices?", r"communications"],
    "governing_law": [r"governing law", r"choice of law", r"jurisdiction"],
    "confidentiality": [r"confidentiality", r"non[- ]disclosure"],
    "payment": [r"payments?", r"fees", r"invoices?", r"taxes"],
    "insurance": [r"insurance"],
    "survival": [r"survival"],
    "indemnity": [r"indemnity", r"indemnification"],
}
