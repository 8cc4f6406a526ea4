"""What the DuckDB twins take as given, written out: the twins share nothing with the
package under test, so a wrong list, pattern or template there shows as a difference."""

# Fixed values.

EXCLUDE_FILES = [
    'quarry_report.md', 'quarry_report.csv', 'quarry_report.tsv',
]
BINARY_EXTS = [
    '.png', '.jpg', '.jpeg', '.gif', '.svg', '.ico', '.woff', '.woff2', '.ttf', '.eot', '.pdf',
    '.bin', '.gz', '.wav', '.class', '.jar', '.whl', '.dylib', '.so', '.a', '.o', '.framework',
    '.dmg', '.app', '.cvsignore', '.super',
]
NOTABLE_FILES = [
    'pom.xml', 'build.gradle', 'settings.gradle', 'package.json', 'go.mod', 'requirements.txt',
    'Gemfile', 'Podfile', 'Cargo.toml', 'composer.json', 'web.xml', 'AndroidManifest.xml',
    'Info.plist', 'Makefile', 'GNUmakefile',
]
SEVERITIES = [
    'Critical', 'High', 'Medium', 'Low',
]
CONFIDENCE_LEVELS = [
    'High', 'Medium', 'Low', 'Unverified',
]
SEVERITY_ORDER = {'Critical': 4, 'High': 3, 'Medium': 2, 'Low': 1}
CONFIDENCE_ORDER = {'High': 3, 'Medium': 2, 'Low': 1, 'Unverified': 0, 'Unknown': 0}
CONFIDENCE_MARKS = {'High': '✅', 'Medium': '🟡', 'Low': '⚠️'}
UNKNOWN_MARK = '❔'
TAINT_ARROW = ' → '
PROFILE_DEPTH = 3
NUL_SNIFF_BYTES = 8192
DEFAULT_MAX_FILE_SIZE = 0
EXCLUDED_DIR_PATTERN = '^(\\.quarry_state|\\.git|\\.svn|node_modules|vendor|build|dist|\\.venv|__pycache__|\\.idea|\\.vscode|ThirdParty/wheelhouse|Source/Regression)/'
STATE_DIR_PATTERN = '(^|/)\\.quarry_state[^/]*/'
SUFFIX_PATTERN = '[^/.][^/]*([.][^./]+)$'

# (id, name, label, extensions, basenames) in category order
SCANNERS = [
    ('B1', 'access_control', 'Broken Access Control',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.rb', '.go', '.kt',
     ],
     []),
    ('B2', 'crypto', 'Cryptographic Failures',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.go', '.kt', '.c', '.xml', '.properties',
     ],
     []),
    ('B3', 'injection', 'Injection',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.sql', '.rb', '.go', '.kt', '.sh', '.xml',
         '.properties',
     ],
     []),
    ('B4', 'insecure_design', 'Insecure Design',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.go', '.kt', '.rb',
     ],
     []),
    ('B5', 'misconfiguration', 'Security Misconfiguration',
     [
         '.yml', '.yaml', '.json', '.xml', '.env', '.properties', '.ini', '.conf', '.plist',
         '.gradle',
     ],
     []),
    ('B6', 'vuln_components', 'Vulnerable and Outdated Components',
     [
         '.gradle', '.xml', '.json',
     ],
     [
         'pom.xml', 'build.gradle', 'settings.gradle', 'package.json', 'go.mod', 'go.sum',
         'Gemfile', 'Gemfile.lock', 'requirements.txt', 'Podfile', 'Podfile.lock', 'Cargo.toml',
         'Cargo.lock', 'composer.json',
     ]),
    ('B7', 'auth', 'Identification and Authentication Failures',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.rb', '.go', '.kt', '.properties',
     ],
     []),
    ('B8', 'data_integrity', 'Software and Data Integrity Failures',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.go', '.kt', '.c', '.xml',
     ],
     []),
    ('B9', 'logging', 'Security Logging and Monitoring Failures',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.go', '.kt', '.c', '.properties', '.xml',
         '.conf',
     ],
     []),
    ('B10', 'ssrf', 'Server-Side Request Forgery',
     [
         '.java', '.py', '.m', '.h', '.js', '.ts', '.go', '.kt', '.rb', '.properties',
     ],
     []),
]

# (rule, scanner, severity, pattern, explanation, fix, source, sink)
RULES = [
    ('hardcoded-token',
     'B2',
     'High',
     'token = "[0-9a-f]+"',
     'Hard-coded credential literal',
     'Load the secret from a vault or environment',
     None,
     None),
    ('template-marker',
     'B3',
     'Critical',
     '%%% .*%%%',
     'Unescaped template markers around interpolated text',
     'Escape or parameterise interpolated values',
     'request param',
     'template render'),
    ('license-line',
     'B6',
     'Low',
     '(Licensed|Released) under',
     'Third-party component licence declaration to inventory',
     'Pin and audit the component version',
     None,
     None),
    ('email-address',
     'B9',
     'Medium',
     '[A-Za-z0-9_.]@[A-Za-z0-9_.]',
     'Personal data (e-mail address) written to text or logs',
     'Mask personal data before logging',
     '',
     None),
    ('card-number',
     'B9',
     'High',
     '[0-9]{16}',
     'Card-number-like digits written to text or logs',
     'Never log payment data',
     '  ',
     None),
    ('ipv4-literal',
     'B10',
     'Medium',
     '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}',
     'Hard-coded network address reachable from request handling',
     'Resolve outbound hosts from an allowlist',
     'url parameter',
     'outbound request'),
    ('debug-enabled',
     'B5',
     'Medium',
     '[Dd]ebug *[:=] *[Tt]rue',
     'Debug mode enabled in configuration',
     'Disable debug in deployed configuration',
     None,
     None),
    ('open-access',
     'B1',
     'High',
     '(permitAll|AllowAnonymous|csrf[(][)][.]disable)[(]?',
     'Access check switched off',
     'Require authentication and keep request forgery checks',
     None,
     None),
    ('weak-algorithm',
     'B2',
     'Medium',
     '(MD5|SHA1|SHA-1|RC4|3DES)[("\')]',
     'Weak hash or cipher',
     'Use SHA-256 or better, AES-GCM',
     None,
     None),
    ('dynamic-code',
     'B3',
     'High',
     '[^A-Za-z0-9_.](eval|exec|system)[(]',
     'Text run as code or as a command',
     'Call a function or pass an argument list',
     'caller input',
     'interpreter'),
    ('unchecked-login',
     'B7',
     'High',
     'verify_?(signature|exp|ssl)?["\']? *[:=] *([Ff]alse|0)',
     'Signature, expiry or certificate check switched off',
     'Keep verification on',
     None,
     None),
    ('unsafe-load',
     'B8',
     'High',
     '(pickle[.]loads?|yaml[.]load|readObject|unserialize)[(]',
     'Untrusted data turned into objects',
     'Use a data-only format and check it',
     'external data',
     'deserializer'),
    ('metadata-address',
     'B10',
     'Critical',
     '169[.]254[.]169[.]254',
     'Address of a cloud metadata service',
     'Block link-local addresses in outbound requests',
     'url parameter',
     'outbound request'),
]

ALLOWLIST = [
    (0, 'B9', '*', '0', 'mail ok', 'confirmed'), (1, '*', 'src/en/src0/d460/.env', '1', 'exact',
    'confirmed'), (2, 'B6', '*', '1', 'first line', 'candidate'), (3, 'B3', '*', '2', 'line 2',
    'confirmed'), (4, '*', '*', '2', 'any line 2', 'confirmed'),
]
CONFIDENCES = ['High', 'Medium', 'Low', 'Unknown']
EXPLOITABLE = ['yes', 'no', 'conditional']

SCAN_TEMPLATE = (
    'You review source code for <label> (<id>, <name>).\n'
    'File: {filename}\n'
    '\n'
    '{file_content}\n'
    '\n'
    'Reply with a JSON array of findings; each finding is an object with line, severity, code, explanation, fix, source, sink. Use {{}} for an object literal in prose. Reply [] when clean.\n'
)
VERIFY_TEMPLATE = (
    'Try to refute each finding for {filename}.\n'
    '\n'
    '{file_content}\n'
    '\n'
    'Findings:\n'
    '{findings_json}\n'
    '\n'
    'Reply with a JSON array; each entry has line, verdict (confirmed|refuted), confidence (High|Medium|Low), exploitable (yes|no|conditional), verification_reason.\n'
)


def template(scanner) -> str:
    """The scan prompt of a row of SCANNERS."""
    return SCAN_TEMPLATE.replace("<id>", scanner[0]).replace("<name>", scanner[1]).replace(
        "<label>", scanner[2])
