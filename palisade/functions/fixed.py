"""Word lists, patterns and limits that results depend on. Nothing here is logic."""

from __future__ import annotations

#: Phrases known from attacks.
SIGNATURES = [
    "ignore previous instructions", "ignore all instructions", "ignore above instructions", "ignore the above", "ignore your instructions",
    "disregard previous instructions", "disregard all instructions", "disregard the above", "forget previous instructions", "forget all instructions",
    "forget your instructions", "override previous instructions", "override system prompt", "bypass safety", "bypass all safety",
    "skip your instructions", "dismiss previous instructions", "from now on you are", "your new instructions are", "your real instructions are",
    "system prompt is", "systemprompt", "reveal your instructions", "print your instructions", "show your system prompt",
    "repeat your system prompt", "what are your instructions", "tell me your instructions", "output your system prompt", "display hidden instructions",
    "print hidden data", "reveal hidden data", "show all stored", "/* bypass", "*/",
    "# bypass", "reveal all passwords", "show stored credentials",
]

#: Words of which a text must have one for the rules of a category to be tried.
ANCHORS = {
    "SQL_COMMAND": ["drop", "truncate", "delete", "select *", "update", "insert into", "create user", "grant", "where 1=1", "where 1 = 1", "--", "/*"],
    "OVERRIDE": ["ignore", "disregard", "forget", "override", "bypass", "new system", "new instruction", "system prompt", "system_prompt", "disable", "turn off", "supersedes", "has priority over"],
    "ROLE_PLAY": ["you are now", "act as", "pretend", "i am now", "simulate", "assume i am", "treat me as", "respond as if", "no longer", "developer mode", "god mode", "debug mode", "jailbreak", "jailbroken", "dan", "do anything now"],
    "OBFUSCATION": ["/*", "*/"],
    "CONTEXT_HIJACK": ["assistant:", "[inst]", "[sys]", "[system]", "[user]", "[assistant]", "<<sys>>", "<</sys>>", "<|im_start|>", "<|im_end|>", "human:", "user:"],
    "DATA_ESCALATION": ["password", "credential", "token", "secret", "api key", "private key", "information_schema", "sys.tables", "pg_catalog", "sqlite_master", "grant", "escalate", "elevate"],
}

#: Fixed values: (name, category, flags, pattern) in order of evaluation; i: any case, s: the dot takes line ends.
RULES = [
    ("sql_drop_command", "SQL_COMMAND", "i", r"\b(drop|truncate)\s+(table|database|schema|index)\b"),
    ("sql_bulk_delete", "SQL_COMMAND", "i", r"\b(delete|remove)\s+(all|every|the\s+entire|all\s+records\s+(from|in))\b"),
    ("sql_bulk_update", "SQL_COMMAND", "i", r"\b(update|modify|change|set)\s+[^\n]{0,40}(all\s+users|every\s+user|all\s+accounts|all\s+records)\b"),
    ("sql_privilege_write", "SQL_COMMAND", "i", r"\b(insert\s+into|create\s+user|grant\s+(admin|root|superuser))\b"),
    ("sql_select_star", "SQL_COMMAND", "i", r"\bselect\s+\*\s+from\b"),
    ("sql_always_true_clause", "SQL_COMMAND", "i", r"""\bwhere\s+['\"]?1['\"]?\s*=\s*['\"]?1['\"]?\b"""),
    ("sql_comment_bypass", "SQL_COMMAND", "i", r"(--|#|\/\*)\s*(bypass|ignore|override|admin|hack)"),
    ("override_instructions", "OVERRIDE", "i", r"\b(ignore|disregard|forget|override)\s+(all\s+)?(previous|prior|above|earlier|your)?\s*(instructions?|rules?|guidelines?|prompts?|constraints?|restrictions?|system\s*prompt)\b"),
    ("new_system_instruction", "OVERRIDE", "i", r"\b(new\s+(system\s+)?(message|instruction|prompt|command|directive))\s*:?\s*(now|you|ignore|override|disable)\b"),
    ("system_prompt_assignment", "OVERRIDE", "i", r"""\b(system\s*prompt|system_prompt)\s*[=:]\s*['\"]?\s*['\"]?\b"""),
    ("disable_safety", "OVERRIDE", "i", r"\b(bypass|disable|remove|turn\s+off)\s+(safety|security|filter|restriction|guard|limit|policy)\b"),
    ("override_priority_claim", "OVERRIDE", "i", r"\b(this\s+(message|instruction|override|token)\s+(supersedes|overrides?|replaces?|has\s+priority\s+over))\b"),
    ("identity_assumption", "ROLE_PLAY", "i", r"\b(i\s+am\s+now|act\s+as|you\s+are\s+now|pretend\s+(you\s+are|to\s+be)|simulate)\s+(user|admin|administrator|root|superuser|user\s+id\s*\d+)\b"),
    ("treat_as_other_user", "ROLE_PLAY", "i", r"\b(assume\s+i\s+am|treat\s+me\s+as|respond\s+as\s+if\s+i\s+(am|were))\s+(user|admin|id\s*\d+)\b"),
    ("unrestricted_mode_claim", "ROLE_PLAY", "i", r"\b(you\s+are\s+(no\s+longer|not)\s+a?\s*(restricted|limited|safe|chatbot|assistant))\b"),
    ("special_mode_activation", "ROLE_PLAY", "i", r"\b(developer\s+mode|god\s+mode|maintenance\s+mode|debug\s+mode|test\s+mode|legacy\s+mode)\s+(enabled?|activated?|is\s+on)\b"),
    ("known_jailbreak_keyword", "ROLE_PLAY", "i", r"\b(jailbreak|jailbroken|DAN|do\s+anything\s+now|STAN|strive\s+to\s+avoid\s+norms)\b"),
    ("sql_block_comment", "OBFUSCATION", "s", r"\/\*.*?\*\/"),
    ("character_spacing_obfuscation", "OBFUSCATION", "", r"(\w\s){4,}"),
    ("fullwidth_unicode", "OBFUSCATION", "", r"[\uFF01-\uFF5E]"),
    ("zero_width_characters", "OBFUSCATION", "", r"[\u200B-\u200D\uFEFF]"),
    ("fake_assistant_response", "CONTEXT_HIJACK", "i", r"\b(assistant\s*:\s*(i\s+will|sure|okay|of\s+course)\b.{0,60}(ignore|override|dump|show\s+all))"),
    ("fake_chat_template_tags", "CONTEXT_HIJACK", "", r"\[\s*(INST|SYS|SYSTEM|system|user|assistant)\s*\]"),
    ("llm_template_injection", "CONTEXT_HIJACK", "", r"<\|im_start\|>|<\|im_end\|>|<<SYS>>|<</SYS>>"),
    ("fake_conversation_transcript", "CONTEXT_HIJACK", "i", r"(human|user)\s*:\s*.{0,60}\n\s*(ai|assistant|bot)\s*:"),
    ("credential_access_request", "DATA_ESCALATION", "i", r"\b(show|list|give\s+me|retrieve|dump|export)\s+(all\s+)?(user\s*)?(password|credential|token|secret|api\s*key|private\s*key|auth)\b"),
    ("bulk_data_access_request", "DATA_ESCALATION", "i", r"\b(all\s+(users?|records?|accounts?|rows?|data|tables?|columns?))\s+(in\s+the\s+)?(database|system|table)\b"),
    ("schema_enumeration", "DATA_ESCALATION", "i", r"\b(information_schema|sys\.tables|pg_catalog|sqlite_master)\b"),
    ("privilege_escalation", "DATA_ESCALATION", "i", r"\b(grant|elevate|escalate)\s+[^\n]{0,30}(admin|root|superuser|privilege)\b"),
]
ALWAYS_TRIED = "OBFUSCATION"

#: Fixed values: (name, category, pattern), any case, for the fields of query results, in order of evaluation.
FIELD_RULES = [
    ("ignore_instructions", "OVERRIDE", r"ignore\s+(all\s+)?previous\s+instructions?"),
    ("system_prompt", "OVERRIDE", r"(system|admin)\s*(prompt|override|message)\s*[=:]"),
    ("system_message", "OVERRIDE", r"<\|im_start\|>|<<SYS>>"),
    ("drop_table", "SQL_COMMAND", r"\bDROP\s+TABLE\b"),
    ("bulk_select", "SQL_COMMAND", r"\bSELECT\s+\*\s+FROM\b"),
    ("bulk_delete", "SQL_COMMAND", r"\bDELETE\s+FROM\b"),
    ("forget_instructions", "ROLE_CHANGE", r"forget\s+your\s+(instructions?|guidelines?|rules?)"),
    ("unrestricted_mode", "ROLEPLAY", r"you\s+are\s+now\s+(unrestricted|an?\s+admin|in\s+\w+\s+mode)"),
    ("reveal_credentials", "OVERRIDE", r"(reveal|dump|expose|output)\s+(all\s+)?(password|credential|token|secret)"),
]

#: Without one of these words among its tokens, a text passes the classifier's decision at once.
SQL_WORDS = ["select", "from", "where", "join", "drop", "insert", "update", "delete", "create", "alter", "table", "database", "information_schema", "sqlite_master"]
TRIGGER_WORDS = ["ignore", "bypass", "override", "disregard", "forget", "reveal", "dump", "exfiltrate", "jailbreak", "unrestricted"]
LABELS = ["SAFE", "DANGEROUS", "INJECTION"]

#: Operations known to the SQL policy, and those refused wherever their word stands.
ALL_OPERATIONS = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "MERGE"]
ALWAYS_REFUSED = ["DROP", "TRUNCATE", "ALTER", "CREATE", "MERGE"]

#: Parts of the names of tools that read the database, and names and parts of names of tools that send data out.
DB_TOOL_PARTS = ["sql", "query", "database", "db"]
NETWORK_TOOLS = ["requests_get", "requests_post", "http", "web", "send_email", "file_write", "upload", "search"]
NETWORK_TOOL_PARTS = ["email", "post", "send", "write", "upload", "http"]
DROPPED_TOOL = "sql_db_query_checker"
QUERY_TOOL = "sql_db_query"

#: What replaces a flagged field.
PLACEHOLDER = "[CONTENT REDACTED: INDIRECT INJECTION DETECTED]"
