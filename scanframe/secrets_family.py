"""Secret rules of this engine's own; they claim no parity with any other catalogue.

Each is (name, pattern, severity, category, description), run over raw text of every file.
Names in ``functions.source.VALIDATED`` have their quoted literal checked for placeholders.
"""

SECRET_RULES = (
    ("Hex Token", r"token\s*=\s*\"[0-9a-f]{40}\"", "HIGH", "SECRET", "A 40-digit token is assigned in plain text."),
    ("Private Key Block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "CRITICAL", "SECRET", "A private key is stored in plain text."),
    ("Cloud Key Id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "CRITICAL", "CLOUD", "A cloud access key id is stored in plain text."),
    ("Bearer Header", r"authorization\s*[:=]\s*[\"']?bearer\s+[a-z0-9._-]{20,}", "HIGH", "SECRET", "A bearer token is stored in plain text."),
    ("Hardcoded Credential", r"\b(?:password|passwd|secret|api_key)\s*[:=]\s*[\"'][^\"'\n]{6,}[\"']", "HIGH", "SECRET", "A credential is assigned in plain text."),
    ("Connection String", r"\b(?:postgres|mysql|mongodb|redis|amqp)(?:ql)?://[^\s:@/]+:[^\s:@/]+@", "HIGH", "DATABASE", "A connection string holds a password."),
)
