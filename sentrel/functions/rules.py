"""Rule tables for the taggers: data with a language, an order, a pattern, a category and attributes.

The defaults cover the common calls of each language; a project's own or larger tables are read with
``load``. Patterns are Java regular expressions on one line of text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    language: str  # "*" for any
    pattern: str
    category: str
    cwe: str = ""
    protects: tuple[str, ...] = field(default=())
    group: int = 0  # the group that is the match's value


def calls(language: str, category: str, cwe: str, *names: str) -> list[Rule]:
    """Rules for calls of functions by their (dotted) names."""
    body = "|".join(re.escape(n) for n in names)
    return [Rule(language, rf"(?<![\w.])(?:{body})\s*\(", category, cwe)]


def _any(names: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(n) for n in names) + ")"


def members(language: str, category: str, owner: str, *names: str, protects: tuple[str, ...] = (), cwe: str = "") -> Rule:
    """A rule for members of a named object."""
    return Rule(language, rf"\b{re.escape(owner)}\.{_any(names)}\b", category, cwe, protects=protects)


def methods(language: str, category: str, *names: str, protects: tuple[str, ...] = (), cwe: str = "") -> Rule:
    """A rule for method calls on any object."""
    return Rule(language, rf"\.{_any(names)}\s*\(", category, cwe, protects=protects)


def guards(language: str, category: str, protects: tuple[str, ...], *names: str) -> Rule:
    """A rule for calls of functions that protect."""
    return Rule(language, rf"(?<![\w.]){_any(names)}\s*\(", category, protects=protects)


def marks(language: str, category: str, *names: str, group: int = 0) -> Rule:
    """A rule for annotations and attributes by their names."""
    return Rule(language, rf"[@\[]({_any(names)})\b", category, group=group)


def routes(language: str, category: str, *owners: str) -> Rule:
    """A rule for routes that are registered on an application object; the value is the method."""
    return Rule(language, rf"\b{_any(owners)}\.({_any(VERBS)})\s*\(", category, group=1)


def variables(language: str, category: str, *names: str) -> Rule:
    """A rule for variables that a language gives its programs; a name that ends in a letter ends there."""
    return Rule(language, "|".join(re.escape(n) + (r"(?!\w)" if n[-1].isalnum() else "") for n in names), category)


def made(language: str, category: str, cwe: str, *names: str) -> Rule:
    """A rule for objects that are made of a class."""
    return Rule(language, rf"\bnew\s+{_any(names)}\s*[(<{{]", category, cwe)


def commands(language: str, category: str, cwe: str, *names: str) -> Rule:
    """A rule for commands by their names, whatever the case: at a line's start or after a pipe, a bracket or an assignment."""
    return Rule(language, rf"(?i)(?:^|[|;&(={{])\s*{_any(names)}(?![\w-])", category, cwe)


VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
_SCRIPTS, _NATIVE, _JVM = ("javascript", "typescript"), ("c", "cpp"), ("java", "kotlin", "scala")

SINKS = [
    *calls("python", "command_execution", "CWE-78", "os.system", "os.popen", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output"),
    *calls("python", "code_execution", "CWE-95", "eval", "exec", "compile", "__import__"),
    *calls("python", "deserialization", "CWE-502", "pickle.load", "pickle.loads", "marshal.loads", "yaml.unsafe_load"),
    Rule("python", r"\byaml\.load\s*\(\s*(?!.*SafeLoader)", "deserialization", "CWE-502"),
    Rule("python", r"\.execute(?:many)?\s*\(", "sql_injection", "CWE-89"),
    Rule("python", r"\b(?:requests|httpx)\.(?:get|post|put|delete|head|patch|request)\s*\(|\burlopen\s*\(", "ssrf", "CWE-918"),
    Rule("python", r"\bopen\s*\(\s*[^'\"\s)]", "path_traversal", "CWE-22"),
    Rule("python", r"\brender_template_string\s*\(|\.from_string\s*\(", "template_injection", "CWE-1336"),
    Rule("python", r"\b(?:etree|ElementTree|ET|minidom)\.(?:parse|fromstring|parseString)\s*\(", "xxe", "CWE-611"),
    Rule("python", r"\bhashlib\.(?:md5|sha1)\s*\(", "weak_crypto", "CWE-328"),
    Rule("python", r"\brandom\.(?:random|randint|choice)\s*\(", "weak_random", "CWE-338"),
    *[r for lang in ("javascript", "typescript") for r in (
        *calls(lang, "code_execution", "CWE-95", "eval", "Function", "vm.runInContext"),
        Rule(lang, r"\b(?:child_process\.)?(?:execSync|execFile|spawn|spawnSync)\s*\(", "command_execution", "CWE-78"),
        Rule(lang, r"\.query\s*\(\s*[`'\"].*(?:\$\{|\+)", "sql_injection", "CWE-89"),
        Rule(lang, r"\binnerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML", "xss", "CWE-79"),
        Rule(lang, r"\b(?:fetch|axios\.\w+)\s*\(\s*[^'\"`\s]", "ssrf", "CWE-918"),
        Rule(lang, r"__proto__|Object\.assign\s*\(|\bmerge\s*\(", "prototype_pollution", "CWE-1321"),
        Rule(lang, r"\bMath\.random\s*\(", "weak_random", "CWE-338"))],
    *[r for lang in _JVM for r in (
        Rule(lang, r"Runtime\.getRuntime\(\)\.exec\s*\(|new\s+ProcessBuilder\s*\(", "command_execution", "CWE-78"),
        Rule(lang, r"\.(?:executeQuery|executeUpdate|createQuery)\s*\(\s*[^)]*\+", "sql_injection", "CWE-89"),
        Rule(lang, r"\breadObject\s*\(|new\s+XMLDecoder\s*\(", "deserialization", "CWE-502"),
        Rule(lang, r"\bDocumentBuilderFactory\.newInstance\s*\(|SAXParserFactory\.newInstance\s*\(", "xxe", "CWE-611"),
        Rule(lang, r"\bparseExpression\s*\(", "spel_injection", "CWE-917"),
        Rule(lang, r"new\s+(?:File|FileInputStream|FileReader)\s*\(\s*[^\"\s]", "path_traversal", "CWE-22"),
        Rule(lang, r"MessageDigest\.getInstance\s*\(\s*\"(?:MD5|SHA-?1)\"", "weak_crypto", "CWE-328"),
        made(lang, "deserialization", "CWE-502", "ObjectInputStream"), methods(lang, "deserialization", "fromXML", "enableDefaultTyping", cwe="CWE-502"),
        methods(lang, "sql_injection", "createNativeQuery", "createSQLQuery", "nativeSQL", "addBatch", cwe="CWE-89"),
        methods(lang, "open_redirect", "sendRedirect", cwe="CWE-601"), methods(lang, "ssrf", "openConnection", "openStream", "getForObject", "getForEntity", "postForObject", cwe="CWE-918"),
        *calls(lang, "reflection_invoke", "CWE-470", "Class.forName"), methods(lang, "reflection_invoke", "getDeclaredMethod", "newInstance", cwe="CWE-470"),
        made(lang, "weak_random", "CWE-338", "Random"), Rule(lang, r"Cipher\.getInstance\s*\(\s*\"(?:DES|RC4|[A-Z]+/ECB)", "weak_crypto", "CWE-327"),
        made(lang, "ldap_injection", "CWE-90", "InitialDirContext", "InitialLdapContext"), Rule(lang, r"\bXPath\w*\.(?:compile|evaluate)\s*\(", "xpath_injection", "CWE-643"),
        Rule(lang, r"\bScriptEngine\b|\bOgnl\.getValue\s*\(|\bMVEL\.eval\s*\(", "code_execution", "CWE-95"), made(lang, "file_write", "CWE-73", "FileOutputStream", "FileWriter", "RandomAccessFile"))],
    *[r for lang in ("c", "cpp") for r in (
        *calls(lang, "buffer_overflow", "CWE-120", "strcpy", "strcat", "sprintf", "gets", "memcpy", "memmove"),
        Rule(lang, r"\b(?:printf|syslog)\s*\(\s*[A-Za-z_]\w*\s*[,)]", "format_string", "CWE-134"),
        *calls(lang, "command_execution", "CWE-78", "system", "popen", "execl", "execvp"),
        *calls(lang, "toctou", "CWE-367", "access", "tmpnam", "mktemp"))],
    Rule("go", r"\bexec\.Command\s*\(", "command_execution", "CWE-78"),
    Rule("go", r"\.(?:Query|Exec|QueryRow)\s*\(\s*(?:fmt\.Sprintf|[^\"]*\+)", "sql_injection", "CWE-89"),
    Rule("rust", r"\bunsafe\s*\{", "unsafe_block", "CWE-676"), Rule("rust", r"\btransmute\s*[:(]", "transmute", "CWE-843"),
    Rule("rust", r"\bCommand::new\s*\(", "command_execution", "CWE-78"),
    Rule("csharp", r"\bProcess\.Start\s*\(", "command_execution", "CWE-78"), Rule("csharp", r"\bBinaryFormatter\b", "deserialization", "CWE-502"),
    Rule("csharp", r"new\s+SqlCommand\s*\([^)]*\+", "sql_injection", "CWE-89"),
    Rule("php", r"\b(?:system|exec|shell_exec|passthru|popen)\s*\(", "command_execution", "CWE-78"),
    Rule("php", r"\b(?:mysql_query|mysqli_query)\s*\(|->query\s*\(", "sql_injection", "CWE-89"),
    Rule("php", r"\bunserialize\s*\(", "object_injection", "CWE-502"), Rule("php", r"\b(?:include|require)(?:_once)?\s*\(?\s*\$", "file_inclusion", "CWE-98"),
    Rule("ruby", r"\b(?:system|exec|eval|instance_eval)\s*[( ]|`[^`]*#\{", "command_execution", "CWE-78"), Rule("ruby", r"\bMarshal\.load\b|YAML\.load\b", "deserialization", "CWE-502"),
    Rule("scala", r"\bsys\.process\b|Process\s*\(", "command_execution", "CWE-78"),
    Rule("swift", r"\bNSTask\b|\bProcess\s*\(\s*\)", "command_execution", "CWE-78"), Rule("powershell", r"(?i)\bInvoke-Expression\b|\biex\b", "code_execution", "CWE-95"),
    Rule("shell", r"\beval\s", "code_execution", "CWE-95"),
    *calls("python", "command_execution", "CWE-78", "subprocess.getoutput", "subprocess.getstatusoutput", "os.execv", "os.execve", "os.execvp", "os.spawnl", "os.spawnv", "os.posix_spawn", "pty.spawn", "asyncio.create_subprocess_shell"),
    *calls("python", "deserialization", "CWE-502", "dill.load", "dill.loads", "shelve.open", "jsonpickle.decode", "joblib.load", "torch.load", "pandas.read_pickle", "pd.read_pickle"),
    *calls("python", "path_traversal", "CWE-22", "send_file", "os.remove", "os.unlink", "os.rename", "shutil.copy", "shutil.move", "shutil.rmtree", "shutil.unpack_archive"), methods("python", "path_traversal", "extractall", cwe="CWE-22"),
    *calls("python", "reflection_invoke", "CWE-470", "importlib.import_module", "getattr", "setattr"), *calls("python", "open_redirect", "CWE-601", "redirect"), *calls("python", "xss", "CWE-79", "Markup", "mark_safe"),
    methods("python", "ldap_injection", "search_s", "search_ext_s", cwe="CWE-90"), methods("python", "xpath_injection", "xpath", cwe="CWE-643"), *calls("python", "toctou", "CWE-367", "tempfile.mktemp", "os.access"), Rule("python", r"\bverify\s*=\s*False\b", "security_misconfig", "CWE-295"),
    *[r for lang in _SCRIPTS for r in (
        *calls(lang, "code_execution", "CWE-95", "vm.runInNewContext", "vm.runInThisContext"), Rule(lang, r"\bset(?:Timeout|Interval)\s*\(\s*['\"`]", "code_execution", "CWE-95"),
        *calls(lang, "path_traversal", "CWE-22", "fs.readFile", "fs.readFileSync", "fs.createReadStream", "fs.unlink", "fs.readdir"), methods(lang, "path_traversal", "sendFile", cwe="CWE-22"), *calls(lang, "file_write", "CWE-73", "fs.writeFile", "fs.writeFileSync", "fs.appendFile", "fs.createWriteStream"),
        methods(lang, "open_redirect", "redirect", cwe="CWE-601"), methods(lang, "xss", "insertAdjacentHTML", "writeln", cwe="CWE-79"), Rule(lang, r"\bouterHTML\s*=", "xss", "CWE-79"), methods(lang, "deserialization", "unserialize", cwe="CWE-502"), Rule(lang, r"\$where\b|\$expr\b", "nosql_injection", "CWE-943"),
        Rule(lang, r"\brequire\s*\(\s*[^'\"`\s)]", "dynamic_require", "CWE-829"), Rule(lang, r"createHash\s*\(\s*['\"](?:md5|sha1)['\"]", "weak_crypto", "CWE-328"), Rule(lang, r"\brejectUnauthorized\s*:\s*false\b", "security_misconfig", "CWE-295"))],
    *[r for lang in _NATIVE for r in (
        *calls(lang, "buffer_overflow", "CWE-120", "vsprintf", "strncat", "wcscpy", "wcscat", "stpcpy", "bcopy", "scanf", "sscanf"), *calls(lang, "command_execution", "CWE-78", "execlp", "execv", "execve", "execvpe", "posix_spawn"), *calls(lang, "code_execution", "CWE-114", "dlopen", "LoadLibrary"),
        *calls(lang, "weak_random", "CWE-338", "rand", "srand", "random", "drand48"), *calls(lang, "weak_crypto", "CWE-328", "MD5", "MD5_Init", "SHA1", "SHA1_Init", "DES_ecb_encrypt", "RC4"), *calls(lang, "toctou", "CWE-367", "stat", "lstat", "chmod", "chown", "tempnam"), *calls(lang, "path_traversal", "CWE-22", "fopen", "freopen", "unlink"))],
    Rule("cpp", r"\breinterpret_cast\s*<", "type_confusion", "CWE-843"), Rule("cpp", r"\bdelete\s*\[\s*\]", "delete_array", "CWE-415"), Rule("cpp", r"\bstd::rand\s*\(", "weak_random", "CWE-338"),
    *calls("go", "path_traversal", "CWE-22", "os.Open", "os.OpenFile", "os.ReadFile", "os.Remove", "os.RemoveAll", "ioutil.ReadFile", "http.ServeFile"), *calls("go", "file_write", "CWE-73", "os.Create", "os.WriteFile", "ioutil.WriteFile"), *calls("go", "ssrf", "CWE-918", "http.Get", "http.Post", "http.PostForm", "http.NewRequest"),
    *calls("go", "command_execution", "CWE-78", "exec.CommandContext", "syscall.Exec", "os.StartProcess"), *calls("go", "xss", "CWE-79", "template.HTML", "template.JS", "template.URL"), *calls("go", "deserialization", "CWE-502", "gob.NewDecoder"), *calls("go", "open_redirect", "CWE-601", "http.Redirect"),
    *calls("go", "weak_crypto", "CWE-328", "md5.New", "md5.Sum", "sha1.New", "sha1.Sum", "des.NewCipher", "rc4.NewCipher"), *calls("go", "weak_random", "CWE-338", "rand.Int", "rand.Intn", "rand.Float64"), *calls("go", "code_execution", "CWE-114", "plugin.Open"), Rule("go", r"\bunsafe\.Pointer\b", "raw_pointer", "CWE-787"), Rule("go", r"\bInsecureSkipVerify\s*:\s*true\b", "security_misconfig", "CWE-295"),
    Rule("rust", r"\b(?:fs::(?:read|read_to_string|remove_file|remove_dir_all)|File::open)\s*\(", "path_traversal", "CWE-22"), Rule("rust", r"\b(?:fs::write|File::create)\s*\(", "file_write", "CWE-73"), Rule("rust", r"\breqwest::(?:blocking::)?get\s*\(", "ssrf", "CWE-918"), Rule("rust", r"\b(?:sql_query|query|execute)\s*\(\s*&?format!", "sql_injection", "CWE-89"),
    Rule("rust", r"\b(?:bincode::deserialize|serde_yaml::from_str|rmp_serde::from_slice)\b", "deserialization", "CWE-502"), Rule("rust", r"\b(?:from_raw_parts(?:_mut)?|get_unchecked(?:_mut)?|from_utf8_unchecked|from_raw)\s*\(", "raw_pointer", "CWE-787"), Rule("rust", r"\bextern\s+\"C\"", "ffi", "CWE-676"), Rule("rust", r"\b(?:Md5|Sha1)::new\s*\(", "weak_crypto", "CWE-328"),
    made("csharp", "deserialization", "CWE-502", "LosFormatter", "SoapFormatter", "NetDataContractSerializer", "ObjectStateFormatter", "JavaScriptSerializer"), methods("csharp", "sql_injection", "FromSqlRaw", "ExecuteSqlRaw", "ExecuteSqlCommand", cwe="CWE-89"), made("csharp", "ldap_injection", "CWE-90", "DirectorySearcher"),
    *calls("csharp", "path_traversal", "CWE-22", "File.ReadAllText", "File.ReadAllBytes", "File.Open", "File.OpenRead", "File.Delete", "Directory.Delete"), *calls("csharp", "file_write", "CWE-73", "File.WriteAllText", "File.WriteAllBytes", "File.AppendAllText"), methods("csharp", "ssrf", "GetAsync", "PostAsync", "GetStringAsync", "DownloadString", cwe="CWE-918"),
    *calls("csharp", "xss", "CWE-79", "Html.Raw"), made("csharp", "xxe", "CWE-611", "XmlDocument", "XmlTextReader"), methods("csharp", "xpath_injection", "SelectNodes", "SelectSingleNode", cwe="CWE-643"), *calls("csharp", "weak_crypto", "CWE-328", "MD5.Create", "SHA1.Create", "DES.Create"), made("csharp", "weak_random", "CWE-338", "Random"),
    *calls("csharp", "reflection_invoke", "CWE-470", "Assembly.Load", "Assembly.LoadFrom", "Activator.CreateInstance", "Type.GetType"), *calls("csharp", "open_redirect", "CWE-601", "Redirect", "Response.Redirect"),
    *calls("php", "code_execution", "CWE-95", "eval", "assert", "create_function"), *calls("php", "command_execution", "CWE-78", "proc_open", "pcntl_exec"), *calls("php", "path_traversal", "CWE-22", "file_get_contents", "fopen", "readfile", "file", "unlink", "opendir"), *calls("php", "file_write", "CWE-73", "file_put_contents", "move_uploaded_file"),
    *calls("php", "ssrf", "CWE-918", "curl_init", "curl_exec", "fsockopen"), *calls("php", "xxe", "CWE-611", "simplexml_load_string", "simplexml_load_file"), methods("php", "xxe", "loadXML", cwe="CWE-611"), *calls("php", "weak_crypto", "CWE-328", "md5", "sha1"), *calls("php", "weak_random", "CWE-338", "rand", "mt_rand", "uniqid"),
    *calls("php", "variable_overwrite", "CWE-621", "extract", "parse_str"), *calls("php", "ldap_injection", "CWE-90", "ldap_search", "ldap_list"), Rule("php", r"\b(?:echo|print)\b[^;]*\$_(?:GET|POST|REQUEST|COOKIE)\b", "xss", "CWE-79"), Rule("php", r"\bheader\s*\(\s*['\"]Location:", "open_redirect", "CWE-601"), *calls("php", "information_disclosure", "CWE-200", "phpinfo", "var_dump", "print_r"),
    *calls("ruby", "command_execution", "CWE-78", "IO.popen", "Open3.capture2", "Open3.capture3", "Open3.popen3", "Process.spawn", "Kernel.system"), methods("ruby", "code_execution", "class_eval", "module_eval", cwe="CWE-95"), methods("ruby", "sql_injection", "find_by_sql", "exec_query", cwe="CWE-89"), Rule("ruby", r"\.(?:where|order|joins)\s*\(\s*\"[^\"]*#\{", "sql_injection", "CWE-89"),
    *calls("ruby", "path_traversal", "CWE-22", "File.open", "File.read", "File.delete", "IO.read", "send_file"), Rule("ruby", r"\bNet::HTTP\.(?:get|post)\w*\b|\bURI\.open\s*\(", "ssrf", "CWE-918"), Rule("ruby", r"\.html_safe\b|\braw\s*\(", "xss", "CWE-79"), Rule("ruby", r"\.constantize\b|\.(?:public_)?send\s*\(", "reflection_invoke", "CWE-470"), *calls("ruby", "open_redirect", "CWE-601", "redirect_to"), Rule("ruby", r"\bDigest::(?:MD5|SHA1)\b", "weak_crypto", "CWE-328"),
    Rule("scala", r"\bsql\"[^\"]*#\$", "sql_injection", "CWE-89"), Rule("kotlin", r"\.(?:rawQuery|execSQL)\s*\(", "sql_injection", "CWE-89"), methods("kotlin", "xss", "loadUrl", "evaluateJavascript", cwe="CWE-79"), *calls("kotlin", "path_traversal", "CWE-22", "File"),
    *calls("swift", "sql_injection", "CWE-89", "sqlite3_exec", "sqlite3_prepare_v2"), Rule("swift", r"\bNSKeyedUnarchiver\.unarchive\w*\s*\(", "deserialization", "CWE-502"), methods("swift", "xss", "evaluateJavaScript", "loadHTMLString", cwe="CWE-79"), Rule("swift", r"\bcontentsOf(?:File|URL)?\s*:", "path_traversal", "CWE-22"), methods("swift", "ssrf", "dataTask", "downloadTask", cwe="CWE-918"),
    Rule("swift", r"\bUnsafe(?:Mutable)?(?:Raw)?(?:Buffer)?Pointer\b", "raw_pointer", "CWE-787"), Rule("swift", r"\bInsecure\.(?:MD5|SHA1)\b", "weak_crypto", "CWE-328"), *calls("swift", "weak_crypto", "CWE-328", "CC_MD5", "CC_SHA1"),
    commands("powershell", "command_execution", "CWE-78", "Start-Process", "Invoke-Command", "Invoke-WmiMethod", "Invoke-CimMethod"), commands("powershell", "code_execution", "CWE-95", "Add-Type"), commands("powershell", "ssrf", "CWE-918", "Invoke-WebRequest", "Invoke-RestMethod", "iwr", "irm", "Start-BitsTransfer"), commands("powershell", "sql_injection", "CWE-89", "Invoke-Sqlcmd"),
    commands("powershell", "deserialization", "CWE-502", "Import-Clixml"), commands("powershell", "path_traversal", "CWE-22", "Remove-Item", "Copy-Item", "Move-Item"), commands("powershell", "file_write", "CWE-73", "Set-Content", "Out-File", "Add-Content"), Rule("powershell", r"(?i)-AsPlainText\b", "hardcoded_secret", "CWE-798"),
    Rule("shell", r"\b(?:ba|z|k)?sh\s+-c\s", "command_execution", "CWE-78"), Rule("shell", r"\|\s*(?:sudo\s+)?(?:ba|z|k)?sh\b", "code_execution", "CWE-494"), Rule("shell", r"(?:^|[;&|]\s*)(?:source|\.)\s+\"?\$", "file_inclusion", "CWE-98"), Rule("shell", r"\brm\s+(?:-\w+\s+)*\"?\$", "path_traversal", "CWE-22"),
    Rule("shell", r"\b(?:curl|wget)\b[^|;]*\$", "ssrf", "CWE-918"), Rule("shell", r"\bchmod\s+(?:-R\s+)?0?777\b", "security_misconfig", "CWE-732"), Rule("shell", r"\bmktemp\s+-u\b", "toctou", "CWE-367"), Rule("shell", r"\$\([^)]*\$[1-9@*]", "command_substitution", "CWE-78"),
    Rule("*", r"(?i)(?:secret|password|api_key|token)\s*=\s*['\"][^'\"\s]{8,}['\"]", "hardcoded_secret", "CWE-798"),
]

SOURCES = [
    members("python", "HTTP_REQUEST", "request", "args", "form", "json", "data", "files", "headers", "cookies", "values", "GET", "POST"),
    Rule("python", rf"@\w+\.{_any(('route', *VERBS))}\s*\(", "HTTP_ROUTE"),
    *calls("python", "STDIN", "", "input", "sys.stdin.read", "sys.stdin.readline"), members("python", "CLI_ARG", "sys", "argv"), members("python", "ENV_VAR", "os", "environ", "environb", "getenv"),
    methods("python", "SOCKET_READ", "recv", "recvfrom", "recv_into"), Rule("python", r"(\w+)\s*=\s*open\s*\(", "FILE_READ", group=1),
    *[r for lang in _SCRIPTS for owner in ("req", "request") for r in (members(lang, "HTTP_REQUEST", owner, "body", "query", "params", "headers", "cookies"),)],
    *[r for lang in _SCRIPTS for r in (routes(lang, "HTTP_ROUTE", "app", "router"), members(lang, "CLI_ARG", "process", "argv"), members(lang, "ENV_VAR", "process", "env"), members(lang, "STDIN", "process", "stdin"))],
    *[r for lang in _JVM for r in (Rule(lang, r"\bgetParameter\s*\(\s*\"([^\"]+)\"", "HTTP_PARAM", group=1), marks(lang, "HTTP_PARAM", "RequestParam", "PathVariable", "QueryParam"), marks(lang, "HTTP_BODY", "RequestBody"), *calls(lang, "ENV_VAR", "", "System.getenv"), methods(lang, "HTTP_HEADER", "getHeader", "getCookies"))],
    *[r for lang in _NATIVE for r in (variables(lang, "CLI_ARG", "argv"), *calls(lang, "ENV_VAR", "", "getenv", "secure_getenv"), *calls(lang, "STDIN", "", "scanf", "fscanf", "fgets", "getline", "gets", "getchar"), *calls(lang, "SOCKET_READ", "", "recv", "recvfrom", "recvmsg"), *calls(lang, "KERNEL_USERSPACE", "", "copy_from_user", "get_user"))],
    members("go", "HTTP_REQUEST", "r", "Body", "Form", "Header", "URL"), methods("go", "HTTP_PARAM", "FormValue", "PostFormValue", "PathValue"), members("go", "CLI_ARG", "os", "Args"), *calls("go", "ENV_VAR", "", "os.Getenv", "os.LookupEnv"), members("go", "STDIN", "os", "Stdin"),
    *calls("rust", "CLI_ARG", "", "env::args", "std::env::args"), *calls("rust", "ENV_VAR", "", "env::var", "std::env::var"), *calls("rust", "STDIN", "", "io::stdin", "stdin"), Rule("rust", r"\bextern\s+\"C\"", "UNSAFE"),
    members("csharp", "HTTP_REQUEST", "Request", "Query", "Form", "Body", "Headers", "Cookies"), *calls("csharp", "STDIN", "", "Console.ReadLine"), *calls("csharp", "ENV_VAR", "", "Environment.GetEnvironmentVariable"),
    variables("php", "HTTP_REQUEST", "$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES"), variables("php", "ENV_VAR", "$_ENV", "$_SERVER"), variables("php", "CLI_ARG", "$argv"),
    variables("ruby", "HTTP_PARAM", "params["), variables("ruby", "CLI_ARG", "ARGV"), variables("ruby", "ENV_VAR", "ENV["), *calls("ruby", "STDIN", "", "gets", "STDIN.read"),
    Rule("powershell", r"(?i)\bparam\s*\(", "PS_PARAM"), variables("powershell", "PS_ARGS", "$args"), variables("powershell", "PS_ENV_VAR", "$env:"), Rule("powershell", r"(?i)\bRead-Host\b", "PS_STDIN"), Rule("powershell", r"(?i)\bGet-Content\b", "PS_FILE_READ"),
    Rule("shell", r"\$(?:[1-9@*]|\{[1-9@*])", "CLI_ARG"), Rule("shell", r"^\s*read\s+\w", "STDIN"),
    methods("kotlin", "HTTP_REQUEST", "receive", "receiveText", "receiveParameters"), *calls("kotlin", "STDIN", "", "readLine", "readln"), members("scala", "HTTP_REQUEST", "request", "body", "queryString", "headers"), *calls("scala", "STDIN", "", "StdIn.readLine"),
    members("swift", "CLI_ARG", "CommandLine", "arguments"), *calls("swift", "STDIN", "", "readLine"), members("swift", "ENV_VAR", "ProcessInfo.processInfo", "environment"),
]

_TEXT = ("xss", "html_injection")
SANITIZERS = [
    guards("python", "shell_escape", ("command_injection",), "shlex.quote"), guards("python", "encoding", _TEXT, "html.escape", "markupsafe.escape", "bleach.clean"), guards("python", "path_check", ("path_traversal",), "os.path.realpath", "os.path.normpath", "secure_filename", "safe_join"),
    guards("python", "safe_load", ("deserialization",), "yaml.safe_load", "json.loads", "ast.literal_eval"), marks("python", "auth_check", "login_required", "permission_required", "jwt_required"), guards("python", "conversion", ("type_confusion",), "int", "float"),
    *[guards(lang, "encoding", _TEXT, "DOMPurify.sanitize", "encodeURIComponent", "encodeURI", "escapeHtml") for lang in _SCRIPTS], *[guards(lang, "conversion", ("type_confusion",), "parseInt", "parseFloat", "Number") for lang in _SCRIPTS],
    *[methods(lang, "parameterized", "prepareStatement", protects=("sql_injection",)) for lang in _JVM], *[methods(lang, "path_check", "getCanonicalPath", "toRealPath", protects=("path_traversal",)) for lang in _JVM],
    *[guards(lang, "length_check", ("buffer_overflow",), "sizeof", "strnlen", "strlcpy") for lang in _NATIVE],
    guards("go", "path_check", ("path_traversal",), "filepath.Clean", "filepath.Rel"), guards("go", "encoding", _TEXT, "html.EscapeString", "template.HTMLEscapeString"), methods("go", "parameterized", "Prepare", "PrepareContext", protects=("sql_injection",)),
    guards("php", "encoding", _TEXT, "htmlspecialchars", "htmlentities", "strip_tags"), guards("php", "shell_escape", ("command_injection",), "escapeshellarg", "escapeshellcmd"), guards("php", "path_check", ("path_traversal",), "realpath", "basename"), guards("php", "conversion", ("type_confusion",), "intval", "floatval"),
    Rule("csharp", r"\bSqlParameter\b", "parameterized", protects=("sql_injection",)), guards("csharp", "path_check", ("path_traversal",), "Path.GetFullPath"), guards("csharp", "encoding", _TEXT, "HttpUtility.HtmlEncode", "WebUtility.HtmlEncode"), marks("csharp", "auth_check", "Authorize"),
    guards("ruby", "shell_escape", ("command_injection",), "Shellwords.escape"), guards("ruby", "encoding", _TEXT, "CGI.escapeHTML", "ERB::Util.html_escape", "sanitize"), guards("ruby", "path_check", ("path_traversal",), "File.expand_path", "File.realpath"),
    methods("rust", "checked_arithmetic", "checked_add", "checked_mul", "saturating_add", "saturating_mul", protects=("integer_overflow", "buffer_overflow")), methods("rust", "path_check", "canonicalize", protects=("path_traversal",)),
    guards("swift", "conversion", ("type_confusion",), "Int", "Double"), Rule("shell", r"\bprintf\s+['\"]?%q", "shell_escape", protects=("command_injection",)), Rule("powershell", r"(?i)\bResolve-Path\b", "path_check", protects=("path_traversal",)),
]

ENTRY_POINTS = [
    Rule("python", rf"@\w+\.({_any(('route', *VERBS))})\s*\(", "http_route", group=1), Rule("python", r"^if\s+__name__\s*==", "main"), Rule("python", r"@\w+\.(?:command|task)\b", "cli"),
    *[routes(lang, "http_route", "app", "router") for lang in _SCRIPTS], *[marks(lang, "http_route", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", group=1) for lang in ("java", "kotlin")],
    Rule("java", r"\bstatic\s+void\s+main\s*\(", "main"), *[Rule(lang, r"\bint\s+main\s*\(", "main") for lang in _NATIVE], Rule("go", r"^func\s+main\s*\(", "main"), *calls("go", "http_route", "", "http.HandleFunc", "http.Handle"), Rule("rust", r"\bfn\s+main\s*\(", "main"),
    marks("csharp", "http_route", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", group=1), Rule("csharp", r"\bstatic\s+(?:async\s+)?\w+\s+Main\s*\(", "main"),
    Rule("ruby", rf"^\s*({_any(VERBS)})\s+['\"]", "http_route", group=1), Rule("php", rf"\bRoute::({_any(VERBS)})\s*\(", "http_route", group=1), Rule("kotlin", r"\bfun\s+main\s*\(", "main"), Rule("kotlin", rf"^\s*({_any(VERBS)})\s*\(\s*\"", "http_route", group=1),
    Rule("scala", r"\bdef\s+main\s*\(|\bextends\s+App\b", "main"), Rule("swift", r"^@main\b", "main"), routes("swift", "http_route", "app", "router", "routes"), Rule("shell", r"^#!", "script"), Rule("powershell", r"(?i)^\s*\[CmdletBinding", "cmdlet"),
]

IMPORTS = [
    Rule("python", r"^\s*(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)", "import", group=0), Rule("javascript", r"(?:require\s*\(|from\s+)\s*['\"]([^'\"]+)['\"]", "import", group=1), Rule("typescript", r"from\s+['\"]([^'\"]+)['\"]", "import", group=1),
    Rule("java", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "import", group=1), Rule("c", r"^\s*#\s*include\s*[<\"]([^>\"]+)", "import", group=1), Rule("cpp", r"^\s*#\s*include\s*[<\"]([^>\"]+)", "import", group=1),
    Rule("go", r"^\s*(?:import\s+)?\"([\w./-]+)\"\s*$", "import", group=1), Rule("rust", r"^\s*use\s+([\w:]+)", "import", group=1), Rule("csharp", r"^\s*using\s+([\w.]+)\s*;", "import", group=1), Rule("php", r"^\s*use\s+([\w\\]+)", "import", group=1), Rule("ruby", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "import", group=1),
    Rule("kotlin", r"^\s*import\s+([\w.*]+)", "import", group=1), Rule("scala", r"^\s*import\s+([\w.]+)", "import", group=1), Rule("swift", r"^\s*import\s+([\w.]+)", "import", group=1),
    Rule("shell", r"^\s*(?:source|\.)\s+([^\s;$]+)", "import", group=1), Rule("powershell", r"(?i)^\s*(?:Import-Module|using\s+module|using\s+namespace)\s+([\w./\\-]+)", "import", group=1),
]

#: Rules for plain text: personal data as sources, secrets and the like as sinks, markup as sanitizers.
TEXT_SOURCES = [
    Rule("*", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL"), Rule("*", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "IPV4"),
    Rule("*", r"\b[0-9]{13,16}\b", "LONG_NUMBER"), Rule("*", r"https?://[^ ]+", "URL"), Rule("*", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "PHONE")]
TEXT_SINKS = [
    Rule("*", r"(?:token|secret|api_key) = \"[0-9A-Za-z]{8,}\"", "hardcoded_secret", "CWE-798"), Rule("*", r"password=[0-9A-Za-z]{8,}", "hardcoded_secret", "CWE-259"),
    Rule("*", r"[Ll]icensed under", "information_disclosure", "CWE-200"), Rule("*", r"[A-Z]{5,}!!", "web_framework", "CWE-1"), Rule("*", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "ssrf", "CWE-918")]
HTML_SANITIZERS = [
    Rule("*", r"&(?:amp|lt|gt|quot|#39);", "encoding", protects=("xss", "html_injection")), Rule("*", r"<script[^>]*nonce=", "csp", protects=("xss",)),
    Rule("*", r"rel=\"[a-z ]*noopener", "link_guard", protects=("csrf",)), Rule("*", r"charset=\"utf-8\"", "charset", protects=("xss",))]


def load(path: str) -> list[Rule]:
    """Rules from a JSON list of objects with the fields of Rule."""
    with open(path, encoding="utf-8") as f:
        return [Rule(**(x | {"protects": tuple(x.get("protects", ()))})) for x in json.load(f)]
