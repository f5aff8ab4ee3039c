"""The patterns, word lists and messages that results are defined by.

They are stated once, in a dialect that both Java's and RE2's regular expressions read (no
look-around, no back-references), and used by the operators and by the SQL of the queries.
"""

from __future__ import annotations

QUOTED = r"""(?:"(?:[^"'\\]|\\.)*"|'(?:[^"'\\]|\\.)*')"""
COMMENT_LINE = r"^\s*//"

# Crypto misuse
WEAK_HASH = r"(?i)\b(MD5|MD5_Init|SHA1|SHA1_Init|EVP_md5|EVP_sha1|md5|sha1)\b"
WEAK_CIPHER = r"(?i)\b(EVP_des|EVP_rc4|DES|RC4|Blowfish|bf_|CAST|AES_encrypt)\b"
HARDCODED_KEY = (
    r"(?i)(?:const\s+)?(?:unsigned\s+)?char\s+\w*(?:key|secret|pass|token|iv)\w*\s*\[\s*\d*\s*\]\s*=\s*"
    r"\{\s*0x[0-9a-fA-F]+\s*(?:,\s*0x[0-9a-fA-F]+\s*){3,}"
)
HARDCODED_STRING = r"""(?i)(?:const\s+)?char\s+\w*(?:key|secret|pass|token)\w*\s*\[\s*\d*\s*\]\s*=\s*"[^"]{4,}\""""
SRAND_TIME = r"(?i)\bsrand\s*\(\s*time\s*\([^)]*\)"
WEAK_RAND = r"(?i)\b(rand|random|srand|lrand48|mrand48|drand48|rand_r)\s*\([^)]*\)"

# Injection, paths, formats
SHELL_SINK = r"\b(system|popen|execl|execlp|execle|execv|execvp|posix_spawn|wf\s*system|ShellExecute)\s*\("
SHELL_USER = r"(?i)\b(argv|argc|getenv|getopt|request|input|buffer|data|cmd|command|str|src|user|param|ctx|msg)\b"
PRINTF_SINK = r"\b(printf|vprintf|sprintf|vsprintf|fprintf|vfprintf|snprintf|vsnprintf|syslog)\s*\("
SAFE_FORMAT = r"""(?:".*%.*"|'.*%.*')\s*,"""
LITERAL_FORMAT = r"""(?:"(?:[^"']*%[^"']*)?"|'(?:[^"']*%[^"']*)?')\s*,"""
PATH_CALL = r"\b(execl|execlp|execle|execv|execvp|execve|system|popen|posix_spawnp)\s*\("
PATH_SET = r"""(?i)(?:setenv|putenv|setlocalenv)\s*\(\s*["']?\s*PATH\b"""
PATH_ASSIGN = r"\bPATH\s*="
OPENER = r"\b(open|openat|fopen|fopen_s|freopen|stat|lstat|fstatat|access|opendir)\s*\("
PATH_USER = r"(?i)\b(argv|argc|optarg|getenv|input|request|user|param|path|file|fname|filename|name|dir|src|data|buf|buffer|ctx|msg)\b"
TRAVERSAL = r"""\.\.\s*[/\\]|\.\.\s*["']"""
LENGTH_SINK = r"\b(memcpy|memmove|read|recv|recvfrom)\s*\("
LENGTH_GUARD = r"if\s*\(.*(<|>|<=|>=|sizeof)"
DESERIALIZER = r"\b(eval|system|exec|popen|dlopen|dlsym)\s*\("
INPUT_SOURCE = r"\b(getenv|argv|stdin|fgets|read)\s*\("
INPUT_SINK = r"\b(memcpy|strcpy|sprintf|system|exec|eval)\b"

# Logic
ASSIGNED = r"(\w+)\s*="
ASSIGNED_CALL = r"(\w+)\s*=\s*\w+\s*\("
NULL_ALLOC = r"\b(malloc|calloc|realloc|strdup|fopen|socket)\s*\("
SIGNAL_CALL = r"(?i)\bsignal\s*\(\s*[A-Za-z0-9_]+,\s*(\w+)\s*\)"
SIGNAL_DECL = r"static\s+.*\b(?:void|int)\s+(\w+)\s*\(\s*int\s*\)"
NOT_SIGNAL_SAFE = (
    r"\b(malloc|free|printf|fprintf|sprintf|snprintf|strcpy|strcat|memcpy|memmove|strlen|strcmp|strdup|fopen|open|read|write|"
    r"close|fclose|getenv|mutex_lock|pthread_mutex_lock|lock|unlock|exit|abort|getcwd|realpath|realloc)\s*\("
)
RESOURCES = {"open": "close", "fopen": "fclose", "socket": "close"}
RECURSION_GUARD = r"if\s*\(.*(<|>|<=|>=|==|!=)|while\s*\(.*(<|>|<=|>=)"
CHECK_CALL = r"\b(access|stat|lstat|stat64|fstat|exists|is_readable|is_writable)\s*\("
USE_CALL = r"\b(open|creat|fopen|openat|unlink|remove|rename|mkstemp|chmod|chown)\s*\("
PLAIN_ARGUMENT = r"^(?:[A-Za-z_][A-Za-z0-9_]*|/[^\s'\"]*)$"
RETURN_CALL = r"\b(malloc|calloc|realloc|open|fopen|socket|read|write|connect|bind|listen|accept|setuid|setgid)\s*\("

# Memory
COPY_SINKS = ["memcpy", "memmove", "memset", "strcpy", "strcat", "sprintf", "gets", "scanf", "sscanf"]
COPY_GUARD = r"if\s*\(.*sizeof|if\s*\(.*length|if\s*\(.*size|if\s*\(.*len"
FREED = r"\b[fF]ree\s*\(\s*(\w+)\s*\)"
FREED_NAME = r"\b[fF]ree\s*\(\s*([A-Za-z_]\w*)\s*\)"
FREE_LINE = r"\b(?:free|delete|Free)\s*\("
PRODUCT = r"=\s*[^;]*\b(\w+)\s*\*\s*(\w+)\b"
SIZE_ALLOC = r"\b(malloc|calloc|realloc|alloca)\s*\("
NUMBER = r"^\d+[uUlL]*$"
OVERFLOW_WORD = r"SIZE_MAX|INT_MAX|(?i:overflow)"
LEAK_ALLOC = r"\b(malloc|calloc|realloc|strdup|open|fopen|socket)\s*\("
LEAK_FREE = r"\b(free|fclose|close)\s*\("
LEAK_FREED = r"free\s*\(\s*(\w+)"
TO_UNSIGNED = r"\(size_t\)\s*\w+|\(unsigned[^)]*\)\s*\w+"
SIGNED_VAR = r"\b(?:int|long|short|ssize_t|off_t)\s+(\w+)\b"
SIZE_CALL = r"\b(memcpy|memmove|memset|strncpy|malloc|calloc|realloc|read|write|recv|send|snprintf)\s*\("
NULL_CHECK = r"\b(?:if|while)\s*\([^)]*!\s*(\w+)\s*\)"
NULL_EQUAL = r"\b(\w+)\s*(?:==\s*NULL|NULL\s*==|!=?\s*NULL)"
SIZE_GUARD = r"(?i)\bif\s*\([^)]*(?:sizeof\s*\(|len(?:gth)?\s*[<>=]|size\s*[<>=]|n\s*[<>=]|MAX_|<=\s*(?:sizeof))"
NOT_CALLEES = ["if", "while", "for", "switch", "assert", "sizeof"]
CONTROL_WORDS = ["if", "while", "for", "switch", "do", "return", "else", "typedef"]

#: Rules in the order that decides ties: name, weakness, category.
RULES = [
    ("crypto-misuse", "CWE-338", "crypto"),
    ("command-injection", "CWE-78", "input"),
    ("format-string", "CWE-134", "input"),
    ("path-hijacking", "CWE-426", "input"),
    ("path-traversal", "CWE-22", "input"),
    ("unchecked-length", "CWE-20", "input"),
    ("unsafe-deserialization", "CWE-502", "input"),
    ("untrusted-input", "CWE-20", "input"),
    ("null-deref", "CWE-476", "logic"),
    ("race-condition", "CWE-362", "logic"),
    ("resource-lifecycle", "CWE-404", "logic"),
    ("stack-recursion", "CWE-674", "logic"),
    ("toctou", "CWE-367", "logic"),
    ("unchecked-return", "CWE-252", "logic"),
    ("buffer-overflow", "CWE-120", "memory"),
    ("double-free", "CWE-415", "memory"),
    ("integer-overflow", "CWE-190", "memory"),
    ("memory-leak", "CWE-401", "memory"),
    ("sign-conversion", "CWE-681", "memory"),
    ("use-after-free", "CWE-416", "memory"),
]

#: Messages of findings; they enter the fingerprint.
TITLES = {
    "hash": "Weak/obsolete hash algorithm (MD5/SHA-1) used",
    "cipher": "Weak/obsolete cipher (DES/RC4/Blowfish) used",
    "secret": "Hard-coded cryptographic key/secret detected",
    "seed": "Predictable PRNG seeded from time()",
    "prng": "Weak/predictable PRNG (rand/random) used",
    "shell": "Potential OS command injection: shell command contains a variable or concatenation",
    "shell-user": "Potential OS command injection: user-derived data near a shell call",
    "format": "Potential format string vulnerability: format argument is not a constant string",
    "path-call": "Untrusted search path: command launched without a fully-qualified path (PATH hijacking candidate)",
    "path-set": "Potential uncontrolled search path: PATH set/modified from runtime data",
    "traversal": "Potential path traversal: user-derived path passed to file/stream opener",
    "length": "Length parameter to '%s' may not be validated",
    "dangerous": "Potentially dangerous call to '%s'",
    "input": "Untrusted input '%s' from '%s' reaches sensitive sink",
    "null": "Potential null dereference: '%s' from '%s' not checked",
    "race": "Potential race/async-signal-safety issue: non-signal-safe '%s' call in handler '%s'",
    "resource": "Potential resource leak: '%s' opened at line %d but not explicitly closed",
    "recursion": "Potential unbounded recursion in '%s': may exhaust stack",
    "toctou": "Potential TOCTOU: file '%s' checked then used without synchronization",
    "return": "Unchecked return value from '%s'",
    "copy": "Unsafe call to '%s': potential buffer overflow",
    "double-free": "Potential double-free: pointer '%s' freed at lines [%s]",
    "size": "Potential integer overflow in size calculation before allocation",
    "product": "Multiplication '%s * %s' without obvious overflow check",
    "leak": "Potential memory leak: '%s' allocated at line %d but no matching free found",
    "sign": "Potential signed to unsigned conversion that may wrap negative values",
    "sign-size": "Potential sign conversion: signed variable '%s' used as a size",
    "use": "Potential use-after-free: pointer '%s' freed at line %d then dereferenced",
}
