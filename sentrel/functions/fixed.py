"""They define the results, so they are stated here as they are."""

# File extensions and languages.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".sc": "scala", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".go": "go", ".rs": "rust", ".cs": "csharp", ".csx": "csharp", ".vb": "csharp", ".rb": "ruby",
    ".php": "php", ".phtml": "php", ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell",
    ".swift": "swift", ".sh": "shell", ".bash": "shell", ".zsh": "shell"}

# Folders that scans skip.
SKIP_FOLDERS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "target", "build", "dist", "vendor", ".next", ".nuxt",
    ".idea", ".vscode", "bin", "obj", "Debug", "Release", "packages", "TestResults", ".deps", ".libs"]

# Severities by rank, and the categories of each; all others are LOW.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_CATEGORIES = {
    "CRITICAL": ["command_execution", "deserialization", "sql_injection", "code_execution", "file_inclusion"],
    "HIGH": [
        "buffer_overflow", "path_traversal", "ssrf", "xxe", "template_injection", "race_condition", "format_string",
        "unsafe_block", "transmute", "ffi", "reflection_invoke", "ldap_injection", "xpath_injection", "spel_injection",
        "nosql_injection", "variable_overwrite", "integer_overflow", "prototype_pollution", "graphql_injection"],
    "MEDIUM": [
        "hardcoded_secret", "weak_crypto", "weak_random", "insecure_crypto", "file_write", "xss", "information_disclosure",
        "string_cast", "data_access", "new_array", "delete_array", "delete_obj", "free", "unsafe_copy", "raw_pointer",
        "web_framework", "command_substitution"]}

# Which protections block a sink category; a category without an entry is blocked by its own name.
TAXONOMY = {
    "command_execution": ["command_injection", "code_execution"], "sql_injection": ["sql_injection"],
    "ssrf": ["ssrf", "url_manipulation"], "path_traversal": ["path_traversal", "file_inclusion"],
    "deserialization": ["deserialization", "code_execution"], "template_injection": ["template_injection", "code_execution"],
    "xxe": ["xxe"], "code_execution": ["command_injection", "code_execution"], "code_injection": ["command_injection", "code_execution"],
    "file_write": ["path_traversal", "file_inclusion"], "file_read": ["path_traversal", "file_inclusion"],
    "file_inclusion": ["file_inclusion", "code_execution"], "ldap_injection": ["ldap_injection"], "xpath_injection": ["xpath_injection"],
    "nosql_injection": ["nosql_injection"], "spel_injection": ["spel_injection"], "reflection_invoke": ["command_injection", "code_execution"],
    "buffer_overflow": ["buffer_overflow"], "format_string": ["format_string"], "auth_bypass": ["auth_bypass", "privilege_escalation"],
    "hardcoded_secret": ["auth_bypass"], "weak_crypto": ["weak_crypto"], "weak_random": ["weak_random"], "race_condition": ["race_condition"],
    "toctou": ["toctou"], "security_misconfig": ["security_misconfig"], "object_injection": ["deserialization", "object_injection"],
    "xss": ["xss", "html_injection"], "html_injection": ["xss", "html_injection"], "csrf": ["csrf"], "type_confusion": ["type_confusion"],
    "integer_overflow": ["buffer_overflow"], "transmute": ["buffer_overflow", "memory_corruption"], "yaml_deserialize": ["deserialization"],
    "prototype_pollution": ["xss", "code_execution"], "graphql_injection": ["nosql_injection"], "dynamic_require": ["path_traversal", "code_execution"]}

# Sink categories that a source type can reach; an unlisted type reaches all.
COMPATIBLE = {
    "HTTP_REQUEST": ["command_execution", "sql_injection", "ssrf", "path_traversal", "deserialization", "template_injection", "xxe", "code_execution", "file_write", "file_read", "ldap_injection", "xpath_injection", "nosql_injection", "spel_injection", "reflection_invoke", "buffer_overflow", "race_condition", "format_string", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random", "toctou", "security_misconfig", "object_injection", "code_injection", "prototype_pollution", "graphql_injection"],
    "HTTP_BODY": ["command_execution", "sql_injection", "ssrf", "path_traversal", "deserialization", "code_execution", "file_write", "auth_bypass", "hardcoded_secret", "weak_crypto", "prototype_pollution", "graphql_injection"],
    "HTTP_PARAM": ["command_execution", "sql_injection", "ssrf", "path_traversal", "deserialization", "code_execution", "ldap_injection", "xpath_injection", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random", "security_misconfig", "race_condition", "xxe"],
    "HTTP_QUERY": ["sql_injection", "command_injection", "path_traversal", "ssrf", "auth_bypass", "hardcoded_secret"],
    "HTTP_FORM": ["command_execution", "sql_injection", "path_traversal", "ssrf", "auth_bypass", "hardcoded_secret"],
    "HTTP_ROUTE": ["command_execution", "sql_injection", "path_traversal", "deserialization", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random", "template_injection", "code_execution"],
    "ROUTE_PARAM": ["command_execution", "sql_injection", "ssrf", "path_traversal", "deserialization", "code_execution", "file_write", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random", "template_injection", "ldap_injection", "xpath_injection", "nosql_injection", "spel_injection"],
    "HTTP_ROUTE_PARAM": ["command_execution", "sql_injection", "ssrf", "path_traversal", "deserialization", "code_execution", "file_write", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random", "template_injection"],
    "CLI_ARG": ["command_execution", "sql_injection", "path_traversal", "code_execution", "buffer_overflow", "format_string", "file_inclusion", "file_write", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random"],
    "ENV_VAR": ["command_execution", "sql_injection", "path_traversal", "code_execution", "auth_bypass", "hardcoded_secret", "weak_crypto", "weak_random"],
    "STDIN": ["command_execution", "path_traversal", "buffer_overflow", "format_string", "code_execution", "weak_random"],
    "FILE_READ": ["deserialization", "yaml_deserialize", "command_execution", "code_execution", "weak_crypto", "weak_random"],
    "SOCKET_READ": ["buffer_overflow", "command_execution", "deserialization", "weak_random"],
    "DESERIALIZE": ["code_execution", "command_execution", "file_read"],
    "JSON_INPUT": ["command_execution", "ssrf", "sql_injection", "code_execution", "weak_random"],
    "YAML_DESERIALIZE": ["code_execution", "command_execution", "file_read"],
    "KERNEL_USERSPACE": ["buffer_overflow", "format_string", "integer_overflow", "race_condition"],
    "SYSCALL": ["buffer_overflow", "format_string", "integer_overflow", "race_condition"],
    "IOCTL": ["buffer_overflow", "format_string", "integer_overflow"],
    "UNSAFE": ["buffer_overflow", "format_string", "integer_overflow", "transmute"],
    "FFI_API": ["buffer_overflow", "format_string", "integer_overflow"],
    "PS_PARAM": ["command_execution", "code_execution", "deserialization", "path_traversal"],
    "PS_ARGS": ["command_execution", "code_execution", "path_traversal"],
    "PS_STDIN": ["command_execution", "code_execution"],
    "PS_FILE_READ": ["deserialization", "command_execution", "code_execution"],
    "PS_CLIXML_READ": ["deserialization", "code_execution"],
    "PS_JSON_INPUT": ["code_execution", "command_execution"],
    "PS_HTTP_CLIENT": ["ssrf", "command_execution"]}

# The role of a category in a chain, and which role leads to which.
ROLES = {
    "command_execution": "code_exec", "sql_injection": "data_access", "ssrf": "internal_access", "path_traversal": "file_access",
    "deserialization": "code_exec", "file_write": "persistence", "file_read": "information_theft", "auth_bypass": "access_escalation",
    "hardcoded_secret": "credential_theft", "code_execution": "code_exec", "template_injection": "code_exec", "xxe": "data_access",
    "ldap_injection": "data_access", "xpath_injection": "data_access", "nosql_injection": "data_access", "spel_injection": "code_exec",
    "reflection_invoke": "code_exec", "buffer_overflow": "memory_corruption", "format_string": "memory_corruption",
    "weak_crypto": "crypto_failure", "weak_random": "crypto_failure", "race_condition": "logic_bypass", "toctou": "logic_bypass",
    "security_misconfig": "exposure", "object_injection": "code_exec", "code_injection": "code_exec"}
TRANSITIONS = [
    ("information_theft", "access_escalation", "credential_reuse"), ("information_theft", "internal_access", "recon_to_ssrf"),
    ("internal_access", "code_exec", "SSRF to RCE"), ("file_access", "code_exec", "LFI to RCE"),
    ("file_access", "information_theft", "source_disclosure"), ("persistence", "file_access", "write_to_include"),
    ("persistence", "code_exec", "file_write_to_rce"), ("data_access", "information_theft", "data_exfiltration"),
    ("data_access", "access_escalation", "credential_extraction"), ("access_escalation", "code_exec", "privileged_execution"),
    ("access_escalation", "data_access", "admin_data_access"), ("logic_bypass", "code_exec", "race_to_rce"),
    ("logic_bypass", "data_access", "race_to_exfil"), ("crypto_failure", "access_escalation", "crypto_to_auth_bypass"),
    ("crypto_failure", "information_theft", "weak_crypto_exposure"), ("credential_theft", "access_escalation", "credential_to_bypass"),
    ("credential_theft", "internal_access", "credential_to_pivot"), ("memory_corruption", "code_exec", "memory_to_code_exec"),
    ("exposure", "access_escalation", "misconfig_to_bypass")]

# Base weights of categories; boosts by language and by framework name; others weigh 1.
WEIGHTS = {
    "command_execution": 10, "code_execution": 10, "deserialization": 9, "sql_injection": 8, "auth_bypass": 8,
    "template_injection": 7, "spel_injection": 7, "command_injection": 7, "ssrf": 6, "xxe": 6, "file_inclusion": 6,
    "reflection_invoke": 6, "path_traversal": 5, "file_write": 5, "race_condition": 5, "nosql_injection": 5,
    "buffer_overflow": 5, "format_string": 5, "graphql_injection": 4, "ldap_injection": 4, "xpath_injection": 4,
    "prototype_pollution": 4, "integer_overflow": 4, "unsafe_block": 4, "hardcoded_secret": 3, "file_read": 3,
    "weak_crypto": 2, "weak_random": 2, "insecure_crypto": 2}
LANGUAGE_BOOSTS = {
    "c": {"buffer_overflow": 5, "format_string": 5, "integer_overflow": 5, "race_condition": 3},
    "c++": {"buffer_overflow": 5, "format_string": 5, "integer_overflow": 5, "race_condition": 3},
    "python": {"deserialization": 2, "template_injection": 2, "command_execution": 1},
    "javascript": {"prototype_pollution": 5, "nosql_injection": 4, "ssrf": 2, "template_injection": 2},
    "typescript": {"prototype_pollution": 5, "nosql_injection": 4, "ssrf": 2, "template_injection": 2},
    "java": {"deserialization": 5, "spel_injection": 5, "sql_injection": 2},
    "c#": {"deserialization": 3, "command_execution": 2}, "go": {"race_condition": 4, "command_execution": 2},
    "rust": {"unsafe_block": 5, "ffi": 4, "integer_overflow": 3}, "ruby": {"deserialization": 3}}
FRAMEWORK_BOOSTS = [
    (("django",), {"sql_injection": 2, "template_injection": 1}), (("flask", "fastapi"), {"template_injection": 2, "ssrf": 1}),
    (("spring",), {"spel_injection": 5, "deserialization": 3}), (("express",), {"nosql_injection": 3, "command_execution": 1}),
    (("rails",), {"deserialization": 4, "sql_injection": 1}), (("ruby",), {"deserialization": 3})]

# The alternative scorer's points.
SEVERITY_POINTS = {"CRITICAL": 1000, "HIGH": 500, "MEDIUM": 100, "LOW": 10, "INFO": 1}
CLASS_POINTS = {
    "command_execution": 100, "code_execution": 100, "deserialization": 80, "sql_injection": 70, "ssrf": 60, "template_injection": 70,
    "auth_bypass": 80, "path_traversal": 50, "file_write": 60, "xxe": 60, "weak_crypto": 30, "hardcoded_secret": 40,
    "race_condition": 50, "weak_random": 30, "ldap_injection": 40, "xpath_injection": 40, "nosql_injection": 50}

# CWE ids of the exploit classes.
CLASS_CWES = {
    "command_injection": ["CWE-77", "CWE-78", "CWE-94", "CWE-95"],
    "memory_safety": ["CWE-119", "CWE-120", "CWE-122", "CWE-125", "CWE-416", "CWE-415", "CWE-476", "CWE-787", "CWE-190", "CWE-191"],
    "sql_injection": ["CWE-89", "CWE-943"], "deserialization": ["CWE-502", "CWE-913"], "ssrf": ["CWE-918", "CWE-441"],
    "auth_bypass": ["CWE-287", "CWE-288", "CWE-289", "CWE-306", "CWE-384", "CWE-613", "CWE-639", "CWE-862", "CWE-863"],
    "path_traversal": ["CWE-22", "CWE-23", "CWE-36", "CWE-73"], "xxe": ["CWE-611", "CWE-776"], "race_condition": ["CWE-362", "CWE-367"],
    "crypto": ["CWE-327", "CWE-328", "CWE-338", "CWE-347", "CWE-798", "CWE-312"],
    "privilege_escalation": ["CWE-250", "CWE-266", "CWE-269", "CWE-271", "CWE-274", "CWE-276"],
    "format_string": ["CWE-134"], "xss": ["CWE-79", "CWE-80"], "integer_overflow": ["CWE-190", "CWE-191", "CWE-680"]}


def category_weights(language: str = "", frameworks: tuple[str, ...] = ()) -> dict[str, int]:
    """Category weights for a code base: the base values and the boosts that apply."""
    out = dict(WEIGHTS)
    named = " ".join(frameworks).lower()
    boosts = [LANGUAGE_BOOSTS.get(language.lower(), {})]
    boosts += [b for names, b in FRAMEWORK_BOOSTS if any(n in named for n in names) and not (names == ("ruby",) and language.lower() == "ruby")]
    for boost in boosts:
        for k, v in boost.items():
            out[k] = out.get(k, 1) + v
    return out
