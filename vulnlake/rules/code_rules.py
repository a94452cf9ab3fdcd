"""Rules for program source text.

Each row is (severity, CWE, languages, title, pattern, message[, options]).
Row order matters: among rules of equal severity the first one wins a line.
"""

from __future__ import annotations

from vulnlake.rules.model import Rule

PY = ("python",)
JS = ("javascript", "typescript")
ALL = ("python", "javascript", "typescript")

# ---------------------------------------------------------------------------
# Titles, severities, CWE ids, patterns and messages decide what
# a finding looks like, so they are stated literally and in rule order.
# ---------------------------------------------------------------------------
_ROWS = [
    # command execution
    ("HIGH", "CWE-78", PY, "Command Injection via os.system()", r"os\.system\s*\([\'\"].*[\'\"]",
     "Potential command injection vulnerability. Avoid using os.system() with user input."),
    ("CRITICAL", "CWE-78", PY, "Command Injection via os.system() with f-string", r"os\.system\s*\(\s*f[\'\"].*\{.*\}",
     "Command injection vulnerability! User input in os.system() f-string allows arbitrary command execution."),
    ("CRITICAL", "CWE-78", PY, "Command Injection via os.system() with concatenation", r"os\.system\s*\([^\)]*\+",
     "Command injection vulnerability! String concatenation in os.system() allows arbitrary command execution."),
    ("CRITICAL", "CWE-78", PY, "Command Injection via os.system() with .format()", r"os\.system\s*\([\'\"].*[\'\"]\.format\s*\(",
     "Command injection vulnerability! .format() in os.system() allows arbitrary command execution."),
    ("CRITICAL", "CWE-78", PY, "Command Injection via subprocess with shell=True", r"subprocess\.(call|run|Popen)\s*\([^)]*shell\s*=\s*True",
     "subprocess with shell=True is extremely dangerous. Avoid using with user input."),
    ("MEDIUM", "CWE-78", PY, "Command Execution via subprocess", r"subprocess\.(call|run|Popen)\s*\(",
     "Subprocess execution detected. Ensure input is properly sanitized."),
    ("CRITICAL", "CWE-94", ALL, "Code Injection via eval()", r"eval\s*\(",
     "eval() allows arbitrary code execution. Never use with untrusted input."),
    ("CRITICAL", "CWE-94", PY, "Code Injection via exec()", r"exec\s*\(",
     "exec() allows arbitrary code execution. Extremely dangerous with user input."),
    # SQL injection, Python
    ("HIGH", "CWE-89", PY, "Potential SQL Injection", r"(execute|cursor\.execute)\s*\(\s*[\'\"].*%s.*[\'\"]",
     "SQL query uses string formatting. Use parameterized queries instead.", {"negative": (r"execute.*%s.*,\s*\(",)}),
    ("HIGH", "CWE-89", PY, "SQL Injection via String Concatenation", r"(execute|cursor\.execute)\s*\(\s*[\'\"].*\s*\+\s*\w+",
     "SQL query uses string concatenation. Extremely vulnerable to injection."),
    ("HIGH", "CWE-89", PY, "SQL Injection via String Concatenation", r"[\'\"]SELECT\s+.*[\'\"]?\s*\+\s*\w+",
     "SQL query built using string concatenation. Use parameterized queries with execute(sql, params)."),
    ("HIGH", "CWE-89", PY, "SQL Injection via String Concatenation", r"[\'\"]INSERT\s+INTO.*[\'\"]?\s*\+\s*\w+",
     "SQL INSERT uses string concatenation. Use parameterized queries."),
    ("HIGH", "CWE-89", PY, "SQL Injection via String Concatenation", r"[\'\"]UPDATE\s+.*[\'\"]?\s*\+\s*\w+",
     "SQL UPDATE uses string concatenation. Use parameterized queries."),
    ("HIGH", "CWE-89", PY, "SQL Injection via String Concatenation", r"[\'\"]DELETE\s+FROM.*[\'\"]?\s*\+\s*\w+",
     "SQL DELETE uses string concatenation. Use parameterized queries."),
    ("HIGH", "CWE-89", PY, "SQL Injection via f-string", r"f[\'\"]SELECT\s+.*\{.*\}",
     "SQL query built using f-string. Use parameterized queries instead."),
    ("HIGH", "CWE-89", PY, "SQL Injection via f-string", r"f[\'\"]INSERT\s+INTO.*\{.*\}",
     "SQL INSERT uses f-string. Use parameterized queries."),
    ("HIGH", "CWE-89", PY, "SQL Injection via f-string", r"f[\'\"]UPDATE\s+.*\{.*\}",
     "SQL UPDATE uses f-string. Use parameterized queries."),
    ("HIGH", "CWE-89", PY, "SQL Injection via f-string", r"f[\'\"]DELETE\s+FROM.*\{.*\}",
     "SQL DELETE uses f-string. Use parameterized queries."),
    ("HIGH", "CWE-89", PY, "SQL Injection via .format()", r"[\'\"]SELECT\s+.*[\'\"]\.format\s*\(",
     "SQL query uses .format(). Use parameterized queries instead."),
    # path traversal, Python
    ("HIGH", "CWE-22", PY, "Path Traversal Attempt", r"open\s*\(\s*[\'\"]\.\./.*[\'\"]",
     "Path contains directory traversal patterns (../). Validate and sanitize file paths."),
    ("HIGH", "CWE-22", PY, "Path Traversal via String Concatenation", r"open\s*\([^\)]*\+",
     "File path built using string concatenation. User input can lead to path traversal attacks."),
    ("MEDIUM", "CWE-22", PY, "Path Traversal via f-string", r"f[\'\"].*/(uploads|files|data|static|public|tmp|temp)/\{",
     "User input in file path can lead to path traversal. Validate and sanitize the path."),
    ("HIGH", "CWE-22", PY, "Path Traversal via open() with f-string", r"open\s*\(\s*f[\'\"].*\{",
     "User input in open() file path allows path traversal attacks."),
    ("MEDIUM", "CWE-22", PY, "Potential Path Traversal", r"open\s*\(\s*\w+\s*[,\)]",
     "Opening file with variable path. Ensure path is validated to prevent traversal."),
    # information disclosure
    ("LOW", "CWE-200", PY, "Information Disclosure via Debug Output", r"print\s*\(\s*f?[\'\"].*DEBUG.*[\'\"]",
     "Debug print statements can leak sensitive information in production."),
    ("LOW", "CWE-200", PY, "Potential Information Disclosure", r"print\s*\(\s*f[\'\"].*\{.*\}.*[\'\"]",
     "Print statement with dynamic content may leak sensitive data. Remove in production."),
    # the alternation below is not grouped: `secret`, `token` and `key` match on their own
    ("MEDIUM", "CWE-200", JS, "Information Disclosure via console.log", r"console\.log\s*\(.*password|secret|token|key",
     "Logging sensitive information to console. Remove in production."),
    # credentials in source
    ("HIGH", "CWE-798", ALL, "Hardcoded Database Username",
     r"(DB_USER|DB_USERNAME|DATABASE_USER|db_user|db_username|admin_user|ADMIN_USER)\s*=\s*[\'\"]([^\'\"]{3,})[\'\"]",
     "Database username hardcoded in source code. Use environment variables instead."),
    ("HIGH", "CWE-798", ALL, "Hardcoded Admin Username",
     r"(username|user|USERNAME|USER)\s*=\s*[\'\"](?!.*\{)[\'\"]*(admin|root|administrator|sa)[\'\"]",
     "Hardcoded admin/root username detected. Use environment variables instead."),
    ("HIGH", "CWE-798", ALL, "Hardcoded Password Detected",
     r"(password|passwd|pwd|pass|PASSWORD|PASSWD|PWD)\s*=\s*[\'\"]([^\'\"]{3,})[\'\"]",
     "Password hardcoded in source code. Use environment variables or secure vaults instead.",
     {"negative": (r"(password|pass|pwd)\s*=\s*[\'\"][\'\"]",)}),
    ("HIGH", "CWE-798", ALL, "Hardcoded API Key Detected",
     r"(apiKey|api_key|API_KEY|apikey|APIKEY|api_secret|API_SECRET)\s*=\s*[\'\"]([^\'\"]{8,})[\'\"]",
     "API key hardcoded in source code. Use environment variables or secure vaults instead."),
    ("HIGH", "CWE-798", ALL, "Hardcoded Secret/Token Detected",
     r"(secret|SECRET|token|TOKEN|auth_token|AUTH_TOKEN)\s*=\s*[\'\"]([^\'\"]{8,})[\'\"]",
     "Secret or token hardcoded in source code. Use environment variables or secure vaults instead."),
    ("CRITICAL", "CWE-798", ALL, "Hardcoded Database Password",
     r"(DB_PASSWORD|DB_PASS|DATABASE_PASSWORD|db_password|db_pass)\s*=\s*[\'\"]([^\'\"]{3,})[\'\"]",
     "Database password hardcoded in source code! Use environment variables immediately."),
    ("CRITICAL", "CWE-798", ALL, "Hardcoded Cloud Credentials",
     r"(AWS_SECRET|AWS_ACCESS_KEY|AZURE_KEY|GCP_KEY|aws_secret|azure_key|gcp_key)\s*=\s*[\'\"]([^\'\"]{8,})[\'\"]",
     "Cloud service credentials hardcoded in source code! Rotate keys and use IAM roles."),
    # deserialization, weak random, weak hash
    ("HIGH", "CWE-502", PY, "Unsafe Deserialization (pickle.loads)", r"pickle\.loads\s*\(",
     "pickle.loads() can execute arbitrary code. Never use with untrusted data."),
    ("HIGH", "CWE-502", PY, "Unsafe Deserialization (pickle.load)", r"pickle\.load\s*\(",
     "pickle.load() can execute arbitrary code. Never use with untrusted data."),
    ("HIGH", "CWE-502", PY, "Unsafe YAML Deserialization", r"yaml\.load\s*\([^)]*\)",
     "yaml.load() without Loader=SafeLoader can execute arbitrary code.",
     {"negative": (r"yaml\.load\s*\([^)]*Loader\s*=\s*SafeLoader",)}),
    ("HIGH", "CWE-502", PY, "Unsafe Deserialization (marshal)", r"marshal\.loads?\s*\(",
     "marshal module can execute arbitrary code. Never use with untrusted data."),
    ("MEDIUM", "CWE-502", PY, "Potential Unsafe Deserialization (shelve)", r"shelve\.open\s*\(",
     "shelve uses pickle internally. Avoid with untrusted data sources."),
    ("MEDIUM", "CWE-338", PY, "Weak Random Number Generator", r"random\.(random|randint)\s*\(",
     "random module is not cryptographically secure. Use secrets module for security."),
    ("MEDIUM", "CWE-327", PY, "Weak Cryptographic Hash (MD5)", r"hashlib\.md5\s*\(",
     "MD5 is cryptographically broken. Use SHA-256 or stronger."),
    ("LOW", "CWE-327", PY, "Weak Cryptographic Hash (SHA1)", r"sha1\s*\(",
     "SHA1 is deprecated. Use SHA-256 or stronger for security purposes."),
    # JavaScript and TypeScript
    ("CRITICAL", "CWE-94", JS, "Code Injection via Function Constructor", r"new\s+Function\s*\(",
     "Function constructor allows arbitrary code execution like eval()."),
    ("HIGH", "CWE-79", JS, "Reflected XSS via res.send() with Template Literal", r"res\.send\s*\(\s*`[^`]*\$\{",
     "User input in res.send() template literal can lead to XSS. Sanitize input or use a templating engine with auto-escaping."),
    ("HIGH", "CWE-79", JS, "Reflected XSS via res.send() with Concatenation", r"res\.send\s*\([^)]*\+",
     "String concatenation in res.send() can lead to XSS. Sanitize user input."),
    ("HIGH", "CWE-79", JS, "XSS via innerHTML", r"\.innerHTML\s*=",
     "innerHTML can execute script tags. Use textContent or sanitize input."),
    ("HIGH", "CWE-79", JS, "XSS via outerHTML", r"\.outerHTML\s*=",
     "outerHTML can execute scripts. Use safer DOM manipulation methods."),
    ("HIGH", "CWE-79", JS, "XSS via document.write", r"document\.write\s*\(",
     "document.write() can introduce XSS. Use safer DOM methods."),
    ("MEDIUM", "CWE-338", JS, "Weak Random Number Generator", r"Math\.random\s*\(",
     "Math.random() is not cryptographically secure. Use crypto.getRandomValues()."),
    ("LOW", "CWE-1023", JS, "Use Strict Equality (===)", r"==\s*[\"\']",
     "Use === instead of == to avoid type coercion vulnerabilities."),
    ("HIGH", "CWE-89", JS, "SQL Injection via String Concatenation", r"(SELECT|INSERT|UPDATE|DELETE).*\+\s*\w+",
     "SQL query uses string concatenation. Use parameterized queries."),
    ("HIGH", "CWE-89", JS, "SQL Injection via Template Literal", r"(SELECT|INSERT|UPDATE|DELETE|DROP).*\$\{",
     "SQL query uses template literals with variables. Use parameterized queries."),
    ("HIGH", "CWE-78", JS, "Command Injection Risk", r"(child_process\.)?(exec|spawn)\s*\(",
     "Command execution detected. Sanitize all user input properly."),
    ("HIGH", "CWE-22", JS, "Path Traversal Risk", r"(fs\.)?(readFile|readFileSync|writeFile|writeFileSync)\s*\(",
     "File operations detected. Validate and sanitize file paths to prevent path traversal."),
    # server-side request forgery
    ("HIGH", "CWE-918", PY, "SSRF - Dynamic URL in requests", r"requests\.(get|post|put|delete|head|patch)\s*\([^\"\')]*\+",
     "HTTP request with dynamic URL. Validate and whitelist allowed URLs to prevent SSRF.", {"owasp": "A10:2021-SSRF"}),
    ("HIGH", "CWE-918", PY, "SSRF - Dynamic URL in urllib", r"urllib\.(request\.)?urlopen\s*\([^\"\')]*\+",
     "urllib with dynamic URL. Validate URLs to prevent SSRF attacks.", {"owasp": "A10:2021-SSRF"}),
    ("HIGH", "CWE-918", PY, "SSRF - Dynamic URL in http client", r"httpx?\.(get|post|request)\s*\([^\"\')]*\+",
     "HTTP client with dynamic URL. Implement URL validation.", {"owasp": "A10:2021-SSRF"}),
    ("HIGH", "CWE-918", JS, "SSRF - Dynamic URL in fetch", r"fetch\s*\(\s*[^\'\"][^\)]+\)",
     "fetch() with dynamic URL variable. Validate URLs to prevent SSRF.", {"owasp": "A10:2021-SSRF"}),
    ("HIGH", "CWE-918", JS, "SSRF - Dynamic URL in axios", r"axios\.(get|post|put|delete|patch)\s*\([^\'\"][^\)]+\)",
     "axios with dynamic URL. Implement URL whitelist validation.", {"owasp": "A10:2021-SSRF"}),
    # access control
    ("HIGH", "CWE-942", ALL, "CORS Wildcard - Allows Any Origin", r"Access-Control-Allow-Origin.*[\"\']?\s*\*\s*[\"\']?",
     "CORS allows all origins. Restrict to specific trusted domains.", {"owasp": "A01:2021-Broken Access Control"}),
    ("HIGH", "CWE-942", JS, "CORS Misconfiguration", r"cors\s*\(\s*\{\s*origin\s*:\s*[\'\"]?\*[\'\"]?",
     "CORS middleware with wildcard origin. Use specific origins.", {"owasp": "A01:2021-Broken Access Control"}),
    ("HIGH", "CWE-22", ALL, "Path Traversal Pattern", r"\.\./\.\./\.\.",
     "Directory traversal pattern detected. Sanitize file paths.", {"owasp": "A01:2021-Broken Access Control"}),
    # further injection
    ("HIGH", "CWE-943", JS, "NoSQL Injection - MongoDB $where", r"\$where\s*:.*(\+|\$\{)",
     "MongoDB $where with dynamic input. Use parameterized queries.", {"owasp": "A03:2021-Injection"}),
    ("MEDIUM", "CWE-943", JS, "NoSQL Injection Risk", r"\.find\s*\(\s*\{[^}]*:\s*\w+\s*\}",
     "MongoDB query with variable input. Validate input types.", {"owasp": "A03:2021-Injection"}),
    ("CRITICAL", "CWE-1336", PY, "Template Injection (SSTI)", r"render_template_string\s*\(",
     "render_template_string can lead to SSTI. Use render_template with separate files.", {"owasp": "A03:2021-Injection"}),
    ("HIGH", "CWE-1336", PY, "Template Injection - Jinja2", r"jinja2\.Template\s*\([^)]*\+",
     "Dynamic Jinja2 template creation. Use static templates.", {"owasp": "A03:2021-Injection"}),
    ("MEDIUM", "CWE-117", PY, "Log Injection Risk", r"(logging\.(info|debug|warning|error)|logger\.\w+)\s*\([^)]*%[^)]*\)",
     "User input may be logged unsafely. Sanitize log inputs.", {"owasp": "A03:2021-Injection"}),
    ("LOW", "CWE-117", JS, "Log Injection Risk", r"console\.(log|info|warn|error)\s*\([^)]*\+[^)]*\)",
     "User input concatenated in console log. Sanitize inputs.", {"owasp": "A03:2021-Injection"}),
    # cryptography
    ("HIGH", "CWE-327", ALL, "Weak Encryption Algorithm", r"DES\s*\(|Blowfish|RC4|RC2",
     "Weak/deprecated encryption. Use AES-256 or ChaCha20.", {"owasp": "A02:2021-Cryptographic Failures"}),
    ("HIGH", "CWE-327", ALL, "Insecure ECB Mode", r"AES.*ECB|ECB.*AES|mode\s*=\s*.*ECB",
     "ECB mode is insecure. Use CBC, GCM, or CTR mode.", {"owasp": "A02:2021-Cryptographic Failures"}),
    ("CRITICAL", "CWE-295", ALL, "SSL Certificate Verification Disabled", r"verify\s*=\s*False|rejectUnauthorized\s*:\s*false",
     "Certificate verification disabled. Enable proper SSL validation.", {"owasp": "A02:2021-Cryptographic Failures"}),
    ("HIGH", "CWE-326", PY, "Deprecated SSL/TLS Version", r"ssl\.PROTOCOL_SSLv[23]|ssl\.PROTOCOL_TLSv1[^23]",
     "Deprecated SSL/TLS version. Use TLS 1.2 or higher.", {"owasp": "A02:2021-Cryptographic Failures"}),
    # configuration
    ("MEDIUM", "CWE-489", ALL, "Debug Mode Enabled", r"DEBUG\s*=\s*True|debug\s*=\s*true|debug:\s*true",
     "Debug mode should be disabled in production.", {"owasp": "A05:2021-Security Misconfiguration"}),
    ("HIGH", "CWE-489", PY, "Flask Debug Mode in Production", r"app\.run\s*\([^)]*debug\s*=\s*True",
     "Flask debug mode exposes sensitive info. Disable in production.", {"owasp": "A05:2021-Security Misconfiguration"}),
    ("HIGH", "CWE-798", ALL, "Hardcoded Secret Key",
     r"SecretKeyCredential.*=.*[\'\"]\w+[\'\"]|SECRET_KEY\s*=\s*[\'\"]\w+[\'\"]",
     "Secret key hardcoded. Use environment variables.", {"owasp": "A05:2021-Security Misconfiguration"}),
    # authentication
    ("CRITICAL", "CWE-347", PY, "JWT Signature Verification Disabled", r"jwt\.decode\s*\([^)]*verify\s*=\s*False",
     "JWT verification disabled. Always verify JWT signatures.", {"owasp": "A07:2021-Auth Failures"}),
    ("CRITICAL", "CWE-347", ALL, "JWT None Algorithm Attack", r"algorithms\s*=\s*\[[\'\"]none[\'\"]\]|algorithm.*none",
     "JWT allows \"none\" algorithm. Use RS256 or HS256.", {"owasp": "A07:2021-Auth Failures"}),
    ("HIGH", "CWE-312", PY, "Password Stored in Session", r"session\[.*\]\s*=\s*.*password|password.*session",
     "Never store passwords in session. Use secure tokens.", {"owasp": "A07:2021-Auth Failures"}),
    # data integrity
    ("HIGH", "CWE-502", PY, "Unsafe YAML Deserialization", r"yaml\.load\s*\([^)]*\)",
     "yaml.load is unsafe. Use yaml.safe_load instead.", {"owasp": "A08:2021-Data Integrity"}),
    ("HIGH", "CWE-79", JS, "XSS via dangerouslySetInnerHTML", r"dangerouslySetInnerHTML",
     "dangerouslySetInnerHTML can lead to XSS. Sanitize content.", {"owasp": "A08:2021-Data Integrity"}),
    ("LOW", "CWE-502", JS, "Unsafe JSON Parsing", r"JSON\.parse\s*\([^)]*\)",
     "JSON.parse on untrusted data. Validate JSON schema.", {"owasp": "A08:2021-Data Integrity"}),
    # design
    ("MEDIUM", "CWE-362", ALL, "A04: Timing-based Logic (Potential Race Condition)", r"sleep\s*\(\s*\d+\s*\)|time\.sleep|Thread\.sleep",
     "Sleep in code may indicate timing-based vulnerability or race condition.", {"owasp": "A04:2021-Insecure Design"}),
    ("LOW", "CWE-1078", ALL, "A04: Security TODO/FIXME Comment", r"TODO.*security|FIXME.*auth|HACK.*password|XXX.*vuln",
     "Security-related TODO comment found. Address before production.", {"owasp": "A04:2021-Insecure Design"}),
    # holds a line break, so it never fires on a single line; kept so that rule numbers stay stable
    ("MEDIUM", "CWE-862", PY, "A04: POST Route Without Auth Decorator",
     r"@app\.route.*methods.*POST.*\n(?!.*@(login_required|requires_auth|authenticated))",
     "POST endpoint may lack authentication. Verify access control.", {"owasp": "A04:2021-Insecure Design"}),
    # components
    ("INFO", "CWE-1035", ALL, "A06: Package Installation Command", r"pip install|npm install|yarn add",
     "Package installation detected. Use pip-audit or npm audit to verify.", {"owasp": "A06:2021-Vulnerable Components"}),
    # logging
    ("HIGH", "CWE-532", ALL, "A09: Password in Log Output", r"(print|console\.log|logging\.\w+|logger\.\w+)\s*\([^)]*password[^)]*\)",
     "Password may be logged. Never log sensitive credentials.", {"owasp": "A09:2021-Logging Failures"}),
    ("HIGH", "CWE-532", ALL, "A09: Token in Log Output", r"(print|console\.log|logging\.\w+|logger\.\w+)\s*\([^)]*token[^)]*\)",
     "Token may be logged. Avoid logging authentication tokens.", {"owasp": "A09:2021-Logging Failures"}),
    ("HIGH", "CWE-532", ALL, "A09: Secret in Log Output", r"(print|console\.log|logging\.\w+|logger\.\w+)\s*\([^)]*secret[^)]*\)",
     "Secret may be logged. Remove sensitive data from logs.", {"owasp": "A09:2021-Logging Failures"}),
    ("HIGH", "CWE-532", ALL, "A09: API Key in Log Output", r"(print|console\.log|logging\.\w+|logger\.\w+)\s*\([^)]*api_key[^)]*\)",
     "API key may be logged. Never log API credentials.", {"owasp": "A09:2021-Logging Failures"}),
    # only the second branch can fire on a single line
    ("MEDIUM", "CWE-390", ALL, "A09: Empty Exception Handler (Silent Failure)", r"except\s*:\s*\n\s*pass|catch\s*\([^)]*\)\s*\{\s*\}",
     "Empty exception handler suppresses errors. Log exceptions for debugging.", {"owasp": "A09:2021-Logging Failures"}),
    ("MEDIUM", "CWE-754", PY, "A09: Broad Exception with No Logging", r"except\s*Exception.*pass|except\s*:\s*pass",
     "Broad exception silently caught. Log errors for security monitoring.", {"owasp": "A09:2021-Logging Failures"}),
]

# A file in which any of these occurs is taken as reviewed: all its findings are dropped.
SAFE_PATTERNS = {
    "python": (
        r"yaml\.safe_load",
        r"execute.*,\s*\([^)]+\)\s*\)",
        r"execute.*,\s*\[[^\]]+\]\s*\)",
        r"os\.environ\.get",
        r"os\.environ\[",
        r"hashlib\.sha256",
        r"hashlib\.sha512",
        r"hashlib\.sha384",
        r"hashlib\.blake2",
        r"secrets\.",
        r"sanitize\s*\(",
        r"escape\s*\(",
        r"requests\.(get|post|put|delete)\s*\(\s*[\"\']https?://",
        r"urllib\.request\.urlopen\s*\(\s*[\"\']https?://",
        r"=\s*os\.environ",
        r"from\s+\.\w+\s+import",
        r"from\s+\.\s+import",
        r"^\s*\w+\s*=\s*\w+\s*[\+\-\*\/]\s*\w+\s*$",
        r"^\s*print\s*\(\s*[\"\'][^\"\']*[\"\']\s*\)\s*$",
    ),
    "javascript": (
        r"textContent\s*=",
        r"createElement",
        r"\?.*=.*\$\d",
        r"encodeURIComponent",
        r"DOMPurify\.sanitize",
        r"fetch\s*\(\s*[\"\']https?://",
        r"axios\.(get|post)\s*\(\s*[\"\']https?://",
        r"process\.env\.",
        r"require\s*\(\s*[\'\"]\.",
        r"from\s+[\'\"]\.",
    ),
    "typescript": (
        r"textContent\s*=",
        r"createElement",
        r"encodeURIComponent",
        r"fetch\s*\(\s*[\"\']https?://",
        r"axios\.(get|post)\s*\(\s*[\"\']https?://",
        r"process\.env\.",
        r"from\s+[\'\"]\.",
    ),
}
# ------------------------------ end of fixed values ------------------------


def _rule(number, row):
    severity, cwe, languages, title, pattern, message, *rest = row
    options = rest[0] if rest else {}
    return Rule(
        number=number,
        rule_id=title.lower().replace(" ", "_"),
        title=title,
        severity=severity,
        cwe_id=cwe,
        message=message,
        pattern=pattern,
        languages=languages,
        negative=options.get("negative", ()),
        owasp=options.get("owasp"),
    )


CODE_RULES = tuple(_rule(i, row) for i, row in enumerate(_ROWS, 1))
