"""Tables of fixed values: rule definitions, names and lists that results depend on."""

# fmt: off

#: Language rules as (name, pattern, severity, category, description, extensions).
LANGUAGE_RULES = (
    ('Python eval(input)', r'eval\s*\(\s*(?:input|raw_input)', 'CRITICAL', 'INJECTION', 'eval() with user input - code injection.', '.py'),
    ('Python exec(input)', r'exec\s*\(\s*(?:input|raw_input)', 'CRITICAL', 'INJECTION', 'exec() with user input.', '.py'),
    ('Python subprocess shell=True', r'subprocess\.\w+\s*\(.*shell\s*=\s*True', 'HIGH', 'INJECTION', 'subprocess with shell=True.', '.py'),
    ('Python os.system', r'os\.system\s*\(', 'HIGH', 'INJECTION', 'os.system() allows command injection.', '.py'),
    ('Python os.popen', r'os\.popen\s*\(', 'HIGH', 'INJECTION', 'os.popen() allows command injection.', '.py'),
    ('Python pickle.load', r'pickle\.loads?\s*\(', 'CRITICAL', 'DESERIALIZATION', 'Pickle deserialization allows RCE.', '.py'),
    ('Python yaml.load', r'yaml\.load\s*\((?!.*Loader)', 'HIGH', 'DESERIALIZATION', 'yaml.load without SafeLoader.', '.py'),
    ('Python marshal.load', r'marshal\.loads?\s*\(', 'CRITICAL', 'DESERIALIZATION', 'Marshal deserialization allows RCE.', '.py'),
    ('Python flask render_template_string', r'render_template_string\s*\(', 'CRITICAL', 'INJECTION', 'Jinja2 SSTI vulnerability.', '.py'),
    ('Python flask send_file', r'send_file\s*\(\s*(?:request|req)', 'HIGH', 'TRAVERSAL', 'Flask send_file with user input.', '.py'),
    ('Python hashlib.md5', r'hashlib\.md5\s*\(', 'HIGH', 'CRYPTO', 'MD5 is cryptographically broken.', '.py'),
    ('Python hashlib.sha1', r'hashlib\.sha1\s*\(', 'MEDIUM', 'CRYPTO', 'SHA1 is deprecated.', '.py'),
    ('Python tempfile.mktemp', r'tempfile\.mktemp\s*\(', 'HIGH', 'CONFIG', 'mktemp() is insecure. Use mkstemp().', '.py'),
    ('Python django DEBUG', r'DEBUG\s*=\s*True', 'HIGH', 'CONFIG', 'Django DEBUG mode enabled.', '.py'),
    ('Python flask debug', r'app\.run\s*\(.*debug\s*=\s*True', 'MEDIUM', 'CONFIG', 'Flask debug mode enabled.', '.py'),
    ('Python chmod 777', r'os\.chmod\s*\(.*0o?777', 'HIGH', 'CONFIG', 'World-writable permissions.', '.py'),
    ('Python requests verify=False', r'requests\.\w+\s*\(.*verify\s*=\s*False', 'HIGH', 'NETWORK', 'SSL verification disabled.', '.py'),
    ('Python importlib user', r'importlib\.import_module\s*\(\s*(?:request|input)', 'CRITICAL', 'INJECTION', 'Dynamic import with user input.', '.py'),
    ('Python glob user', r'glob\.glob\s*\(\s*(?:request|input)', 'MEDIUM', 'TRAVERSAL', 'glob with user input.', '.py'),
    ('Python getattr user', r'getattr\s*\(.*(?:request|input|args)', 'HIGH', 'INJECTION', 'Dynamic attribute access with user input.', '.py'),
    ('Python django raw query', r'''(?:objects\.raw|cursor\.execute)\s*\(\s*[f"\'].*\{.*\}''', 'CRITICAL', 'INJECTION', 'Django raw query with formatting.', '.py'),
    ('Python sqlalchemy text', r'''text\s*\(\s*[f"\'].*\{.*\}''', 'HIGH', 'INJECTION', 'SQLAlchemy text() with formatting.', '.py'),
    ('PHP eval', r'eval\s*\(', 'CRITICAL', 'INJECTION', 'eval() executes arbitrary code.', '.php'),
    ('PHP system', r'system\s*\(', 'CRITICAL', 'INJECTION', 'system() executes commands.', '.php'),
    ('PHP exec', r'exec\s*\(', 'CRITICAL', 'INJECTION', 'exec() executes commands.', '.php'),
    ('PHP passthru', r'passthru\s*\(', 'CRITICAL', 'INJECTION', 'passthru() executes commands.', '.php'),
    ('PHP shell_exec', r'shell_exec\s*\(', 'CRITICAL', 'INJECTION', 'shell_exec() executes commands.', '.php'),
    ('PHP popen', r'popen\s*\(', 'HIGH', 'INJECTION', 'popen() executes commands.', '.php'),
    ('PHP proc_open', r'proc_open\s*\(', 'HIGH', 'INJECTION', 'proc_open() executes commands.', '.php'),
    ('PHP unserialize', r'unserialize\s*\(', 'CRITICAL', 'DESERIALIZATION', 'PHP unserialize allows object injection.', '.php'),
    ('PHP include variable', r'(?:include|require|include_once|require_once)\s*\(\s*\$', 'CRITICAL', 'TRAVERSAL', 'Dynamic include - RFI/LFI.', '.php'),
    ('PHP echo user input', r'(?:echo|print)\s+\$_(?:GET|POST|REQUEST|COOKIE|SERVER)', 'CRITICAL', 'XSS', 'PHP output of user input without escaping.', '.php'),
    ('PHP extract user input', r'extract\s*\(\s*\$_', 'HIGH', 'INJECTION', 'extract() with user input.', '.php'),
    ('PHP parse_str', r'parse_str\s*\(\s*(?:\$_|\$)', 'HIGH', 'INJECTION', 'parse_str() variable overwrite.', '.php'),
    ('PHP preg_replace /e', r'preg_replace\s*\(.*/e', 'CRITICAL', 'INJECTION', 'preg_replace /e - code execution.', '.php'),
    ('PHP create_function', r'create_function\s*\(', 'CRITICAL', 'INJECTION', 'create_function() - code injection.', '.php'),
    ('PHP header injection', r'''header\s*\(\s*["\'].*\$''', 'HIGH', 'INJECTION', 'header() with variable - injection.', '.php'),
    ('PHP file_get_contents url', r'''file_get_contents\s*\(\s*["\']https?://''', 'MEDIUM', 'SSRF', 'file_get_contents with URL.', '.php'),
    ('PHP file_put_contents', r'file_put_contents\s*\(.*\$', 'HIGH', 'TRAVERSAL', 'file_put_contents with variable.', '.php'),
    ('PHP move_uploaded_file', r'move_uploaded_file\s*\(', 'MEDIUM', 'UPLOAD', 'File upload - validate type.', '.php'),
    ('PHP SimpleXML', r'SimpleXMLElement\s*\(', 'MEDIUM', 'XSS', 'PHP SimpleXML - disable external entities.', '.php'),
    ('PHP libxml entity', r'libxml_disable_entity_loader\s*\(\s*false', 'HIGH', 'XSS', 'PHP entity loader enabled.', '.php'),
    ('PHP curl_setopt', r'curl_setopt\s*\(.*CURLOPT_URL', 'MEDIUM', 'SSRF', 'Dynamic URL in cURL.', '.php'),
    ('JS eval', r'(?<!\w)eval\s*\(', 'HIGH', 'INJECTION', 'eval() executes arbitrary code.', '.js .ts .jsx .tsx'),
    ('JS new Function', r'new\s+Function\s*\(', 'HIGH', 'INJECTION', 'Function constructor - code injection.', '.js .ts .jsx .tsx'),
    ('JS child_process', r'child_process\.(?:exec|spawn|execSync)\s*\(', 'HIGH', 'INJECTION', 'Node.js child process.', '.js .ts'),
    ('JS innerHTML', r'\.innerHTML\s*=', 'HIGH', 'XSS', 'innerHTML enables XSS.', '.js .ts .jsx .tsx .html .vue .svelte'),
    ('JS document.write', r'document\.write\s*\(', 'HIGH', 'XSS', 'document.write() enables XSS.', '.js .ts .html'),
    ('JS jQuery html', r'\$\([^)]+\)\.html\s*\(', 'HIGH', 'XSS', 'jQuery .html() enables XSS.', '.js .ts .html'),
    ('JS dangerouslySetInnerHTML', r'dangerouslySetInnerHTML', 'HIGH', 'XSS', 'React dangerouslySetInnerHTML.', '.js .ts .jsx .tsx'),
    ('JS v-html', r'v-html\s*=', 'HIGH', 'XSS', 'Vue v-html renders raw HTML.', '.vue .js .ts'),
    ('JS setTimeout string', r'''setTimeout\s*\(\s*["\']''', 'MEDIUM', 'INJECTION', 'setTimeout with string.', '.js .ts'),
    ('JS setInterval string', r'''setInterval\s*\(\s*["\']''', 'MEDIUM', 'INJECTION', 'setInterval with string.', '.js .ts'),
    ('JS require user', r'require\s*\(\s*(?:req|input|param)', 'HIGH', 'INJECTION', 'Dynamic require with user input.', '.js .ts'),
    ('JS crypto createCipher', r'crypto\.createCipher\s*\(', 'HIGH', 'CRYPTO', 'createCipher is deprecated.', '.js .ts'),
    ('JS fetch user', r'fetch\s*\([^)]*\+', 'MEDIUM', 'SSRF', 'Dynamic URL in fetch.', '.js .ts'),
    ('JS axios user', r'axios\.(?:get|post|put)\s*\([^)]*\+', 'MEDIUM', 'SSRF', 'Dynamic URL in axios.', '.js .ts'),
    ('JS insertAdjacentHTML', r'\.insertAdjacentHTML\s*\(', 'HIGH', 'XSS', 'insertAdjacentHTML enables XSS.', '.js .ts .html'),
    ('JS outerHTML', r'\.outerHTML\s*=', 'HIGH', 'XSS', 'outerHTML enables XSS.', '.js .ts .html'),
    ('JS ng-bind-html', r'ng-bind-html\s*=', 'HIGH', 'XSS', 'Angular ng-bind-html.', '.js .ts .html'),
    ('Java Runtime.exec', r'Runtime\.getRuntime\(\)\.exec\s*\(', 'CRITICAL', 'INJECTION', 'Runtime.exec() execution.', '.java'),
    ('Java ProcessBuilder', r'new\s+ProcessBuilder\s*\(', 'HIGH', 'INJECTION', 'ProcessBuilder - validate arguments.', '.java'),
    ('Java ObjectInputStream', r'ObjectInputStream.*readObject', 'CRITICAL', 'DESERIALIZATION', 'Java deserialization - RCE.', '.java'),
    ('Java Statement.execute', r'''Statement\.execute\s*\(\s*["\'].*\+''', 'CRITICAL', 'INJECTION', 'SQL statement concatenation.', '.java'),
    ('Java JNDI injection', r'(?:InitialContext|lookup)\s*\(\s*(?:request|param)', 'CRITICAL', 'INJECTION', 'JNDI lookup with user input.', '.java'),
    ('Java MD5', r'''MessageDigest\.getInstance\s*\(\s*["\']MD5["\']''', 'HIGH', 'CRYPTO', 'MD5 is broken.', '.java'),
    ('Java SHA1', r'''MessageDigest\.getInstance\s*\(\s*["\']SHA-?1["\']''', 'MEDIUM', 'CRYPTO', 'SHA1 is deprecated.', '.java'),
    ('Java TrustAll SSL', r'SSLContext.*init\s*\(.*null.*TrustAll', 'HIGH', 'NETWORK', 'Trust-all SSL context.', '.java'),
    ('Java XPath injection', r'XPath.*evaluate\s*\(', 'MEDIUM', 'INJECTION', 'XPath with user input.', '.java'),
    ('Java BeanUtils', r'BeanUtils\.populate\s*\(', 'HIGH', 'INJECTION', 'BeanUtils mass assignment.', '.java'),
    ('Java LDAP search', r'(?:DirContext|LdapContext)\.search\s*\(', 'HIGH', 'INJECTION', 'LDAP search - validate input.', '.java'),
    ('C# SqlCommand concat', r'SqlCommand\s*\(.*\+', 'CRITICAL', 'INJECTION', 'SQL concatenation - injection.', '.cs'),
    ('C# BinaryFormatter', r'BinaryFormatter.*Deserialize', 'CRITICAL', 'DESERIALIZATION', '.NET BinaryFormatter RCE.', '.cs'),
    ('C# Response.Write user', r'Response\.Write\s*\(\s*(?:Request|Request\[)', 'HIGH', 'XSS', 'XSS via Response.Write.', '.cs'),
    ('C# MD5 Create', r'MD5\.Create\s*\(', 'HIGH', 'CRYPTO', 'MD5 is broken.', '.cs'),
    ('C# Process.Start', r'Process\.Start\s*\(', 'MEDIUM', 'INJECTION', 'Process.Start - validate args.', '.cs'),
    ('C# AllowAnyOrigin', r'AllowAnyOrigin\s*\(\)', 'MEDIUM', 'CONFIG', 'CORS allows all origins.', '.cs'),
    ('C# Newtonsoft deserialize', r'JsonConvert\.DeserializeObject\s*\(.*Request', 'HIGH', 'DESERIALIZATION', 'Deserializing user JSON.', '.cs'),
    ('Go exec.Command', r'exec\.Command\s*\(', 'HIGH', 'INJECTION', 'Go exec.Command execution.', '.go'),
    ('Go sql.Query concat', r'(?:sql\.Query|db\.Query)\s*\(.*\+', 'CRITICAL', 'INJECTION', 'SQL concatenation - injection.', '.go'),
    ('Go template.HTML', r'template\.HTML\s*\(', 'HIGH', 'XSS', 'template.HTML bypasses escaping.', '.go'),
    ('Go InsecureSkipVerify', r'InsecureSkipVerify\s*:\s*true', 'HIGH', 'NETWORK', 'TLS verification disabled.', '.go'),
    ('Go md5.New', r'md5\.New\s*\(', 'HIGH', 'CRYPTO', 'Go MD5 is broken.', '.go'),
    ('Go sha1.New', r'sha1\.New\s*\(', 'MEDIUM', 'CRYPTO', 'Go SHA1 is deprecated.', '.go'),
    ('Go http.Get user', r'http\.(?:Get|Post|Do)\s*\(\s*(?:req|request)', 'MEDIUM', 'SSRF', 'Go HTTP with user URL.', '.go'),
    ('Ruby system', r'system\s*\(', 'HIGH', 'INJECTION', 'Ruby system() - command injection.', '.rb'),
    ('Ruby exec', r'exec\s*\(', 'HIGH', 'INJECTION', 'Ruby exec() - command injection.', '.rb'),
    ('Ruby Marshal.load', r'Marshal\.load\s*\(', 'CRITICAL', 'DESERIALIZATION', 'Marshal.load - RCE.', '.rb'),
    ('Ruby YAML.load', r'YAML\.load\s*\((?!.*safe)', 'HIGH', 'DESERIALIZATION', 'YAML.load without safe_load.', '.rb'),
    ('Ruby render inline', r'render\s+inline:', 'CRITICAL', 'INJECTION', 'ERB inline rendering - SSTI.', '.rb'),
    ('Ruby send user', r'\.send\s*\(\s*(?:params|input)', 'HIGH', 'INJECTION', 'Ruby send with user input.', '.rb'),
    ('Ruby eval', r'(?:eval|class_eval|module_eval)\s*\(', 'HIGH', 'INJECTION', 'Ruby eval - code injection.', '.rb'),
    ('Perl system', r'system\s*\(', 'HIGH', 'INJECTION', 'Perl system() - command injection.', '.pl .pm'),
    ('Perl exec', r'exec\s*\(', 'HIGH', 'INJECTION', 'Perl exec() - command injection.', '.pl .pm'),
    ('Perl eval', r'eval\s*\(', 'HIGH', 'INJECTION', 'Perl eval - code injection.', '.pl .pm'),
    ('Lua loadstring', r'loadstring\s*\(', 'HIGH', 'INJECTION', 'loadstring() - code injection.', '.lua'),
    ('Lua os.execute', r'os\.execute\s*\(', 'HIGH', 'INJECTION', 'os.execute() - command injection.', '.lua'),
    ('Lua io.popen', r'io\.popen\s*\(', 'HIGH', 'INJECTION', 'io.popen() - command injection.', '.lua'),
    ('ECB Mode', r'modes\.ECB|MODE_ECB', 'HIGH', 'CRYPTO', 'ECB mode is insecure.', '.py .java .cs .go .rb .php'),
    ('Insecure Random (Python)', r'(?<!\w)random\.(?:random|randint|choice)\s*\(', 'MEDIUM', 'CRYPTO', 'Non-cryptographic random.', '.py'),
    ('Insecure Random (JS)', r'Math\.random\s*\(', 'MEDIUM', 'CRYPTO', 'Math.random() is not secure.', '.js .ts .jsx .tsx'),
    ('Insecure Random (Java)', r'new\s+Random\s*\(', 'MEDIUM', 'CRYPTO', 'java.util.Random is not secure.', '.java'),
    ('Insecure Random (Go)', r'(?:rand\.Intn|rand\.Int|rand\.Float)', 'MEDIUM', 'CRYPTO', 'Go math/rand is not secure.', '.go'),
    ('SSRF (Python requests)', r'requests\.(?:get|post|put|delete)\s*\([^)]*\+', 'HIGH', 'SSRF', 'Dynamic URL in requests.', '.py'),
    ('SSRF (Python urllib)', r'urllib\.request\.urlopen\s*\([^)]*\+', 'HIGH', 'SSRF', 'Dynamic URL in urlopen.', '.py'),
    ('SSRF (Java URL)', r'new\s+URL\s*\(\s*(?:request|param)', 'HIGH', 'SSRF', 'Java URL from user input.', '.java'),
    ('XXE (Python xml)', r'(?:xml\.etree\.ElementTree|lxml\.etree)\.parse', 'MEDIUM', 'XSS', 'XML parsing - XXE risk.', '.py'),
    ('XXE (DOMParser)', r'DOMParser\s*\(', 'MEDIUM', 'XSS', 'XML parsing in browser.', '.js .ts'),
    ('SSTI (Twig)', r'\$twig->render\s*\(', 'HIGH', 'INJECTION', 'Twig template injection.', '.php'),
    ('SSTI (Freemarker)', r'Freemarker.*process\s*\(', 'HIGH', 'INJECTION', 'Freemarker template injection.', '.java'),
    ('SSTI (Thymeleaf)', r'Thymeleaf.*process\s*\(', 'HIGH', 'INJECTION', 'Thymeleaf template injection.', '.java'),
    ('Open Redirect (PHP)', r'''header\s*\(\s*["\']Location:\s*["\'].*\$''', 'HIGH', 'REDIRECT', 'PHP redirect with variable.', '.php'),
    ('Open Redirect (JS)', r'window\.location\s*=.*(?:param|query|input)', 'MEDIUM', 'REDIRECT', 'JS redirect with user input.', '.js .ts'),
    ('Insecure Cookie', r'(?:Set-Cookie|set_cookie|res\.cookie)\s*\(.*(?:secure\s*[=:]\s*false|HttpOnly\s*[=:]\s*false)', 'MEDIUM', 'SESSION', 'Insecure cookie settings.', '.php .js .ts .py .rb'),
    ('Django ALLOWED_HOSTS wildcard', r'''ALLOWED_HOSTS\s*=\s*\[[^\]]*[\'"]\*[\'"][^\]]*\]''', 'HIGH', 'CONFIG', "ALLOWED_HOSTS '*' permits host header spoofing.", '.py'),
    ('Django CSRF disabled globally', r'(?:CSRF_MIDDLEWARE|MIDDLEWARE\s*=.*csrf)', 'LOW', 'CONFIG', 'Verify CSRF middleware is present.', '.py'),
    ('Spring actuator full exposure', r'management\.endpoints\.web\.exposure\.include\s*=\s*\*', 'HIGH', 'CONFIG', 'All Spring actuator endpoints exposed - info/heapdump leak secrets.', '.properties .yml .yaml'),
    ('Kotlin Runtime.exec', r'Runtime\.getRuntime\(\)\.exec\s*\(', 'CRITICAL', 'INJECTION', 'Runtime.exec() execution.', '.kt'),
    ('Kotlin rawQuery', r'\.rawQuery\s*\(', 'HIGH', 'INJECTION', 'Android rawQuery - use parameterized selection.', '.kt'),
    ('Swift NSAllowArbitraryLoads', r'NSAllowsArbitraryLoads\s*=\s*(?:true|YES)', 'MEDIUM', 'NETWORK', 'App Transport Security disabled.', '.swift .plist'),
    ('Scala Runtime.exec', r'Runtime\.getRuntime\(\)\.exec\s*\(', 'CRITICAL', 'INJECTION', 'Runtime.exec() execution.', '.scala'),
    ('C system()', r'\bsystem\s*\(', 'HIGH', 'INJECTION', 'system() executes shell commands - injection risk with untrusted input.', '.c .cpp .h .hpp'),
    ('C strcpy', r'\bstrcpy\s*\(', 'HIGH', 'INJECTION', 'strcpy() has no bounds checking - buffer overflow risk. Use strncpy.', '.c .cpp .h .hpp'),
    ('C gets()', r'\bgets\s*\(', 'CRITICAL', 'INJECTION', 'gets() cannot be used safely - remove it.', '.c .cpp .h .hpp'),
)

#: Configuration rules as (name, pattern, severity, category, description); they apply to every file.
CONFIG_RULES = (
    ('Debug Mode', r'(?i)debug\s*[=:]\s*(?:true|1|on|yes)|DEBUG\s*=\s*(?:True|1)', 'MEDIUM', 'CONFIG', 'Debug mode enabled.'),
    ('CORS Wildcard', r'(?i)Access-Control-Allow-Origin.*\*', 'MEDIUM', 'CONFIG', 'CORS wildcard allows any origin.'),
    ('SSL Verify Disabled', r'verify\s*=\s*False', 'HIGH', 'NETWORK', 'SSL verification disabled.'),
    ('SSL Verify Disabled (Go)', r'TLSClientConfig.*InsecureSkipVerify\s*:\s*true', 'HIGH', 'NETWORK', 'Go TLS verification disabled.'),
    ('Insecure HTTP', r'http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.)', 'LOW', 'NETWORK', 'HTTP instead of HTTPS.'),
    ('Version Disclosure', r'''(?i)(?:X-Powered-By|Server)\s*[=:]\s*["\'][^"\']+["\']''', 'LOW', 'INFO', 'Server version disclosed.'),
    ('Directory Listing', r'(?i)Options\s*\+\s*Indexes', 'MEDIUM', 'CONFIG', 'Directory listing enabled.'),
    ('CORS Origin Reflection', r'(?i)Access-Control-Allow-Origin.*req\.headers', 'HIGH', 'CONFIG', 'CORS reflects origin - CSRF risk.'),
    ('Verbose Errors', r'(?i)(?:traceback\.print|e\.printStackTrace)', 'LOW', 'INFO', 'Verbose error output.'),
    ('Info Disclosure (print secrets)', r'(?i)print\s*\(.*(?:password|token|secret|key|credential)', 'HIGH', 'INFO', 'Sensitive data printed.'),
    ('Info Disclosure (console.log)', r'console\.log\s*\(.*(?:password|token|secret|key|credential)', 'HIGH', 'INFO', 'Sensitive data logged.'),
    ('Mass Assignment (Rails)', r'(?:attr_accessible|permit!|params\[)', 'MEDIUM', 'LOGIC', 'Rails mass assignment risk.'),
    ('Log Injection', r'(?i)(?:log|logger|logging)\.\w+\s*\(.*\+', 'LOW', 'INJECTION', 'Log injection via concatenation.'),
    ('File Upload (Django)', r'FileField|ImageField', 'LOW', 'UPLOAD', 'Django file field - validate uploads.'),
)

#: File names that are findings by themselves.
SUSPICIOUS_FILES = {
    '.env': 'Hardcoded secrets in environment file.',
    '.env.local': 'Local env file with secrets.',
    '.env.production': 'Production secrets in plaintext.',
    '.env.staging': 'Staging secrets exposed.',
    '.env.development': 'Dev secrets exposed.',
    'config.json': 'May contain hardcoded API keys.',
    'config.yaml': 'May contain hardcoded credentials.',
    'config.yml': 'May contain hardcoded credentials.',
    'config.toml': 'May contain hardcoded credentials.',
    'config.ini': 'May contain hardcoded credentials.',
    'credentials.json': 'Plaintext credentials file.',
    'secrets.json': 'Secrets file in plaintext.',
    'database.yml': 'Database credentials exposed.',
    'database.json': 'Database credentials exposed.',
    'settings.json': 'May contain embedded secrets.',
    'settings.yaml': 'May contain embedded secrets.',
    '.htpasswd': 'Password file exposed.',
    '.htaccess': 'Access control exposed.',
    'id_rsa': 'SSH private key exposed.',
    'id_ed25519': 'SSH private key exposed.',
    'id_dsa': 'SSH private key exposed.',
    'docker-compose.override.yml': 'Docker secrets exposed.',
    'wp-config.php': 'WordPress DB credentials exposed.',
    '.npmrc': 'NPM auth tokens exposed.',
    '.pypirc': 'PyPI tokens exposed.',
    'kubeconfig': 'Kubernetes cluster access exposed.',
    'server.key': 'TLS private key exposed.',
    'application.yml': 'Spring config with secrets.',
    'application.properties': 'Spring config with secrets.',
    'web.config': 'IIS config may contain secrets.',
    'dump.sql': 'Database dump may contain sensitive data.',
    '.bash_history': 'Shell history may contain passwords.',
    '.zsh_history': 'Shell history may contain passwords.',
    '.mysql_history': 'MySQL history may contain passwords.',
    '.psql_history': 'PostgreSQL history may contain passwords.',
}

#: Vulnerable packages as (package, version, description).
VULNERABLE = (
    ('django', '3.2.0', 'CVE-2021-33203: Directory traversal'),
    ('flask', '2.0.0', 'CVE-2023-30861: Session cookie vulnerability'),
    ('requests', '2.25.0', 'CVE-2023-32681: Proxy-Authorization header leak'),
    ('jinja2', '3.0.0', 'CVE-2024-22195: XSS in xmlattr filter'),
    ('pillow', '9.0.0', 'CVE-2022-22817: Arbitrary code execution'),
    ('cryptography', '3.4.0', 'CVE-2023-23931: Memory corruption'),
    ('urllib3', '1.26.0', 'CVE-2023-43804: Cookie header leak'),
    ('aiohttp', '3.8.0', 'CVE-2023-37276: HTTP request smuggling'),
    ('werkzeug', '2.2.0', 'CVE-2023-25577: Resource consumption'),
    ('setuptools', '65.0.0', 'CVE-2022-40897: ReDoS'),
    ('paramiko', '2.4.0', 'CVE-2022-24302: Auth bypass'),
    ('sqlalchemy', '1.4.0', 'CVE-2023-51794: SQL injection via sandboxed eval'),
    ('express', '4.17.0', 'CVE-2022-24999: Prototype pollution'),
    ('lodash', '4.17.20', 'CVE-2021-23337: Command injection'),
    ('node-fetch', '2.6.0', 'CVE-2022-0235: Info exposure'),
    ('jsonwebtoken', '8.5.0', 'CVE-2022-23529: Insecure key handling'),
    ('axios', '0.21.0', 'CVE-2021-3749: ReDoS'),
    ('minimist', '1.2.5', 'CVE-2020-7598: Prototype pollution'),
    ('ws', '6.2.2', 'CVE-2021-32640: ReDoS via Sec-Websocket-Protocol'),
    ('tar', '4.4.18', 'CVE-2021-32803: Arbitrary file write'),
    ('spring-core', '5.3.0', 'CVE-2022-22965: RCE via data binding'),
    ('spring-web', '5.3.0', 'CVE-2022-22965: Spring4Shell RCE'),
    ('log4j', '2.14.0', 'CVE-2021-44228: Log4Shell RCE'),
    ('log4j-core', '2.14.0', 'CVE-2021-44228: Log4Shell RCE'),
    ('jackson-databind', '2.13.0', 'CVE-2022-42003: DoS via deep nesting'),
    ('commons-text', '1.9', 'CVE-2022-42889: RCE via StringSubstitutor'),
    ('fastjson', '1.2.82', 'CVE-2022-25845: Auto-type deserialization RCE'),
    ('struts-core', '2.5.29', 'CVE-2020-17530: OGNL injection RCE'),
)

#: Dependency manifests by file name.
MANIFESTS = (
    'requirements.txt', 'Pipfile.lock', 'package-lock.json', 'yarn.lock', 'poetry.lock', 'Gemfile.lock', 'composer.lock', 'go.sum', 'Cargo.lock',
    'pom.xml', 'build.gradle',
)

#: Directory names that are pruned at any depth.
EXCLUDED_DIRS = (
    'node_modules', 'vendor', '.git', '__pycache__', '.venv', 'venv', 'dist', 'build', '.idea', '.vscode', 'target', '.gradle', '.next', '.nuxt',
    'coverage', '.tox', 'eggs', 'bower_components', '.terraform', '.cache', 'tmp', 'temp', 'Pods', '.pub-cache', 'carthage', '.bundle', 'generated',
    '.mvn', '__snapshots__', '.gitlab', '.vs', 'obj', 'bin', '.svn',
)

#: File extensions that are read.
TEXT_EXTS = (
    '.py', '.js', '.ts', '.jsx', '.tsx', '.java', '.go', '.rb', '.php', '.c', '.cpp', '.h', '.hpp', '.cs', '.rs', '.swift', '.kt', '.scala', '.env',
    '.ini', '.cfg', '.conf', '.toml', '.yaml', '.yml', '.json', '.xml', '.csv', '.txt', '.md', '.sh', '.bat', '.ps1', '.sql', '.html', '.css',
    '.scss', '.vue', '.svelte', '.dart', '.lua', '.pl', '.pm', '.r', '.m', '.mm', '.groovy', '.gradle', '.properties', '.dockerfile', '.gitignore',
    '.tf', '.hcl',
)

#: Language family by extension.
LANGUAGE_OF_EXT = {
    '.py': 'python',
    '.js': 'javascript',
    '.ts': 'javascript',
    '.jsx': 'javascript',
    '.tsx': 'javascript',
    '.php': 'php',
    '.java': 'java',
    '.go': 'generic',
    '.cs': 'generic',
    '.rb': 'generic',
    '.lua': 'generic',
    '.pl': 'generic',
    '.pm': 'generic',
    '.kt': 'generic',
    '.swift': 'generic',
    '.scala': 'generic',
    '.rs': 'generic',
    '.dart': 'generic',
    '.groovy': 'generic',
    '.c': 'generic',
    '.cpp': 'generic',
    '.h': 'generic',
    '.hpp': 'generic',
}

#: Extensions where # starts a comment.
HASH_COMMENT_EXTS = (
    '.py', '.rb', '.sh', '.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf', '.properties', '.dockerfile', '.r', '.ps1', '.bat', '.php', '.pl', '.pm',
    '.groovy',
)

#: Extensions where // starts a comment.
SLASH_COMMENT_EXTS = (
    '.js', '.ts', '.jsx', '.tsx', '.java', '.go', '.c', '.cpp', '.h', '.hpp', '.cs', '.rs', '.swift', '.kt', '.scala', '.dart', '.groovy', '.sql',
    '.lua', '.css', '.scss',
)

#: Extensions with template literals.
BACKTICK_EXTS = (
    '.js', '.ts', '.jsx', '.tsx',
)

#: Extensions that the context detectors read.
CODE_EXTS = (
    '.py', '.js', '.ts', '.jsx', '.tsx', '.php', '.java', '.cs', '.go', '.rb', '.kt', '.swift', '.scala', '.c', '.cpp', '.h', '.hpp', '.lua', '.pl',
    '.pm', '.groovy', '.dart', '.rs',
)

#: Words that excuse a credential in a test file.
SAFE_CREDENTIAL_WORDS = (
    'example', 'sample', 'demo', 'test', 'mock', 'fake', 'dummy', 'placeholder', 'template', 'tutorial', 'docs',
)

#: Framework hints as (needle, framework), first hit wins.
FRAMEWORK_HINTS = (
    ('flask', 'flask'),
    ('django', 'django'),
    ('fastapi', 'fastapi'),
    ('express', 'express'),
    ('springframework', 'spring'),
    ('gin-gonic', 'gin'),
)

#: Literals that stand for a value to be filled in.
PLACEHOLDERS = (
    '', 'changeme', 'change_me', 'changepassword', 'xxx', 'xxxx', 'xxxxx', 'placeholder', 'example', 'sample', 'dummy', 'test', 'todo', 'fixme',
    'your-password', 'your_password', 'yourpassword', 'your-api-key', 'your_api_key', 'yourapikey', 'insert-password-here', 'none', 'null',
    'undefined', 'true', 'false', 'password', 'username', 'secret', 'my-password', 'mypassword', 'not-set', 'notset', 'unset', 'default',
)

#: Variable names that hold credentials.
CREDENTIAL_NAMES = (
    'password', 'passwd', 'pwd', 'db_password', 'database_password', 'admin_password', 'root_password', 'mysql_password', 'postgres_password',
    'secret', 'secret_key', 'client_secret', 'api_secret', 'api_key', 'apikey', 'app_key', 'access_token', 'auth_token', 'private_key', 'signing_key',
    'encryption_key', 'master_key', 'smtp_password', 'aws_secret_access_key',
)

#: Dangerous calls as (extension, function, severity, category).
DANGEROUS_CALLS = (
    ('.php', 'eval', 'CRITICAL', 'INJECTION'),
    ('.php', 'exec', 'CRITICAL', 'INJECTION'),
    ('.php', 'system', 'CRITICAL', 'INJECTION'),
    ('.php', 'passthru', 'CRITICAL', 'INJECTION'),
    ('.php', 'shell_exec', 'CRITICAL', 'INJECTION'),
    ('.php', 'popen', 'HIGH', 'INJECTION'),
    ('.php', 'proc_open', 'HIGH', 'INJECTION'),
    ('.php', 'pcntl_exec', 'HIGH', 'INJECTION'),
    ('.php', 'assert', 'HIGH', 'INJECTION'),
    ('.php', 'create_function', 'CRITICAL', 'INJECTION'),
    ('.php', 'unserialize', 'CRITICAL', 'DESERIALIZATION'),
    ('.php', 'preg_replace', 'CRITICAL', 'INJECTION'),
    ('.js', 'eval', 'HIGH', 'INJECTION'),
    ('.js', 'exec', 'HIGH', 'INJECTION'),
    ('.ts', 'eval', 'HIGH', 'INJECTION'),
    ('.java', 'exec', 'CRITICAL', 'INJECTION'),
)

#: Identifiers that write markup.
XSS_NAMES = (
    'innerHTML', 'outerHTML', 'document', 'insertAdjacentHTML',
)

#: Token classes as (name, pattern), tried in this order.
TOKEN_CLASSES = (
    ('COMMENT_SINGLE', r'//.*'),
    ('COMMENT_MULTI', r'/\*[\s\S]*?\*/'),
    ('COMMENT_HASH', r'#[^\n]*'),
    ('STRING_SINGLE', r"'(?:\\.|[^'\\])*'"),
    ('STRING_DOUBLE', r'"(?:\\.|[^"\\])*"'),
    ('VARIABLE', r'\$\w+'),
    ('FUNCTION_CALL', r'\b\w+(?=\s*\()'),
    ('NUMBER', r'\b\d+(?:\.\d+)?\b'),
    ('OPERATOR', r'[+\-*/%=<>!&|^~?:]+'),
    ('PUNCTUATION', r'[(){}\[\];,.]'),
    ('IDENT', r'\b[a-zA-Z_]\w*\b'),
    ('NEWLINE', r'\n'),
    ('SKIP', r'[ \t]+'),
)

#: Untrusted sources by extension, in order of preference.
TAINT_SOURCES = {
    '.py': ('request', 'req', 'input', 'args', 'params', 'data', 'form', 'query', 'json', 'body', 'headers', 'cookies', 'sys.argv', 'os.environ', 'os.getenv', 'getenv'),
    '.php': ('$_GET', '$_POST', '$_REQUEST', '$_COOKIE', '$_SERVER', 'php://input'),
    '.js': ('req.query', 'req.body', 'req.params', 'req.headers', 'req.cookies', 'request.query', 'request.body', 'request.params', 'process.argv', 'process.env'),
    '.ts': ('req.query', 'req.body', 'req.params', 'req.headers', 'process.argv', 'process.env'),
    '.java': ('request.getParameter', 'request.getQueryString', 'request.getHeader', 'request.getCookies', 'params.get'),
    '.rb': ('params', 'request.params', 'request.query_string'),
    '.go': ('r.URL.Query', 'r.FormValue', 'r.Form', 'c.Query'),
    '.cs': ('Request.QueryString', 'Request.Form', 'Request.Params', 'Request.Headers'),
    '.kt': ('readLine', 'request.getParameter', 'request.getHeader', 'call.getString', 'params["', "params['", 'System.getenv'),
    '.lua': ('io.read', 'os.getenv', 'arg[', 'ngx.req'),
    '.pl': ('<STDIN>', '$ARGV', 'param(', 'CGI::param', '%ENV'),
    '.c': ('argv', 'fgets', 'gets', 'scanf', 'getenv', 'read('),
    '.cpp': ('std::cin', 'argv', 'getline', 'getenv', 'std::ifstream'),
}

#: Dangerous sinks by extension as (label, pattern, severity).
TAINT_SINKS = {
    '.py': (
        ('eval', r'\beval\s*\(', 'CRITICAL'),
        ('exec', r'\bexec\s*\(', 'CRITICAL'),
        ('__import__', r'\b__import__\s*\(', 'CRITICAL'),
        ('os.system', r'\bos\.system\s*\(', 'HIGH'),
        ('os.popen', r'\bos\.popen\s*\(', 'HIGH'),
        ('subprocess', r'subprocess\.\w+\s*\(', 'HIGH'),
        ('pickle.load', r'pickle\.loads?\s*\(', 'CRITICAL'),
        ('yaml.load', r'yaml\.load\s*\(', 'HIGH'),
        ('marshal.load', r'marshal\.loads?\s*\(', 'CRITICAL'),
        ('render_template_string', r'render_template_string\s*\(', 'CRITICAL'),
        ('send_file', r'send_file\s*\(', 'HIGH'),
        ('open', r'\bopen\s*\(', 'HIGH'),
        ('execute', r'(?:cursor\.execute|\.execute|executemany)\s*\(', 'CRITICAL'),
        ('text', r'\btext\s*\(', 'HIGH'),
        ('raw', r'\.raw\s*\(', 'CRITICAL'),
        ('query', r'\bquery\s*\(', 'CRITICAL'),
    ),
    '.php': (
        ('eval', r'\beval\s*\(', 'CRITICAL'),
        ('exec', r'\b(?:exec|system|passthru|shell_exec|popen|proc_open)\s*\(', 'CRITICAL'),
        ('unserialize', r'\bunserialize\s*\(', 'CRITICAL'),
        ('include', r'\b(?:include|require)(?:_once)?\s*\(', 'CRITICAL'),
        ('echo', r'\b(?:echo|print)\b', 'HIGH'),
        ('header', r'\bheader\s*\(', 'HIGH'),
        ('file_get_contents', r'\bfile_get_contents\s*\(', 'HIGH'),
        ('file_put_contents', r'\bfile_put_contents\s*\(', 'HIGH'),
        ('extract', r'\bextract\s*\(', 'HIGH'),
        ('preg_replace', r'\bpreg_replace\s*\(', 'CRITICAL'),
        ('query', r'->\s*query\s*\(|(?:mysqli_query|mysql_query|pg_query|sqlsrv_query)\s*\(', 'CRITICAL'),
    ),
    '.js': (
        ('eval', r'\beval\s*\(', 'HIGH'),
        ('Function', r'new\s+Function\s*\(', 'HIGH'),
        ('child_process', r'child_process\.\w+\s*\(', 'HIGH'),
        ('innerHTML', r'\.innerHTML\s*=', 'HIGH'),
        ('document.write', r'document\.write\s*\(', 'HIGH'),
        ('insertAdjacentHTML', r'\.insertAdjacentHTML\s*\(', 'HIGH'),
        ('require', r'\brequire\s*\(', 'HIGH'),
        ('query', r'\.query\s*\(', 'CRITICAL'),
        ('execute', r'\.execute\s*\(', 'CRITICAL'),
    ),
    '.ts': (
        ('eval', r'\beval\s*\(', 'HIGH'),
        ('innerHTML', r'\.innerHTML\s*=', 'HIGH'),
        ('query', r'\.query\s*\(', 'CRITICAL'),
        ('execute', r'\.execute\s*\(', 'CRITICAL'),
    ),
    '.java': (
        ('Runtime.exec', r'Runtime\.getRuntime\(\)\.exec\s*\(', 'CRITICAL'),
        ('ProcessBuilder', r'new\s+ProcessBuilder\s*\(', 'HIGH'),
        ('readObject', r'ObjectInputStream.*readObject', 'CRITICAL'),
        ('Statement.execute', r'(?:Statement|PreparedStatement).*execute', 'CRITICAL'),
        ('createStatement', r'\.createStatement\s*\(', 'CRITICAL'),
        ('lookup', r'(?:InitialContext|lookup)\s*\(', 'CRITICAL'),
        ('LDAP.search', r'(?:DirContext|LdapContext)\.search\s*\(', 'HIGH'),
    ),
    '.rb': (
        ('system', r'\bsystem\s*\(', 'HIGH'),
        ('exec', r'\bexec\s*\(', 'HIGH'),
        ('eval', r'\beval\s*\(', 'HIGH'),
        ('Marshal.load', r'Marshal\.load\s*\(', 'CRITICAL'),
        ('send', r'\.send\s*\(', 'HIGH'),
        ('render', r'render\s+inline:', 'CRITICAL'),
    ),
    '.go': (
        ('exec.Command', r'exec\.Command\s*\(', 'HIGH'),
        ('sql.Query', r'(?:sql\.Query|db\.Query)\s*\(', 'CRITICAL'),
        ('template.HTML', r'template\.HTML\s*\(', 'HIGH'),
        ('http.Get', r'http\.(?:Get|Post|Do)\s*\(', 'MEDIUM'),
        ('os.Open', r'os\.Open\s*\(', 'MEDIUM'),
    ),
    '.cs': (
        ('Process.Start', r'Process\.Start\s*\(', 'MEDIUM'),
        ('SqlCommand', r'SqlCommand\s*\(', 'CRITICAL'),
        ('BinaryFormatter', r'BinaryFormatter.*Deserialize', 'CRITICAL'),
        ('Response.Write', r'Response\.Write\s*\(', 'HIGH'),
    ),
    '.kt': (
        ('Runtime.exec', r'Runtime\.getRuntime\(\)\.exec\s*\(', 'CRITICAL'),
        ('ProcessBuilder', r'ProcessBuilder\s*\(', 'HIGH'),
        ('execute', r'\.execute\s*\(|\.rawQuery\s*\(', 'CRITICAL'),
        ('eval', r'eval\s*\(', 'HIGH'),
        ('loadUrl', r'\.loadUrl\s*\(', 'MEDIUM'),
    ),
    '.lua': (
        ('loadstring', r'(?:loadstring|load)\s*\(', 'CRITICAL'),
        ('os.execute', r'os\.execute\s*\(', 'CRITICAL'),
        ('io.popen', r'io\.popen\s*\(', 'CRITICAL'),
        ('dofile', r'''(?:dofile|require)\s*\(?\s*[\'"]?\w''', 'HIGH'),
    ),
    '.pl': (
        ('system', r'\bsystem\s*\(', 'HIGH'),
        ('exec', r'\bexec\s*\(', 'HIGH'),
        ('eval', r'\beval\s*\(', 'HIGH'),
        ('open', r'\bopen\s*\(', 'HIGH'),
        ('backtick', r'`[^`]*\$', 'HIGH'),
    ),
    '.c': (
        ('system', r'\bsystem\s*\(', 'CRITICAL'),
        ('popen', r'\bpopen\s*\(', 'CRITICAL'),
        ('execl', r'\bexec[lv][pe]?\s*\(', 'CRITICAL'),
        ('strcpy', r'\bstrcpy\s*\(', 'HIGH'),
        ('sprintf', r'\bsprintf\s*\(', 'HIGH'),
    ),
    '.cpp': (
        ('system', r'\bsystem\s*\(', 'CRITICAL'),
        ('popen', r'\b_popen\s*\(', 'CRITICAL'),
        ('strcpy', r'\bstrcpy\s*\(', 'HIGH'),
        ('exec-family', r'\bexec[lv][pe]?\s*\(', 'CRITICAL'),
    ),
}

#: Assignment patterns by extension; group 1 is the target.
TAINT_ASSIGNMENTS = {
    '.py': r'(\w+)\s*=\s*',
    '.php': r'\$(\w+)\s*=\s*',
    '.js': r'(?:const|let|var)\s+(\w+)\s*=\s*',
    '.ts': r'(?:const|let|var)\s+(\w+)\s*=\s*',
    '.java': r'(?:String|Object|Integer|Long|var)\s+(\w+)\s*=\s*',
    '.rb': r'(\w+)\s*=\s*',
    '.go': r'(\w+)\s*:?=\s*',
    '.cs': r'(?:string|var)\s+(\w+)\s*=\s*',
    '.kt': r'(?:val|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*',
    '.lua': r'(?:local\s+)?(\w+)\s*=\s*',
    '.pl': r'my\s+\$?(\w+)\s*=\s*',
    '.c': r'(?:char|int|char\s*\*)\s*\*?\s*(\w+)\s*=\s*',
    '.cpp': r'(?:std::string|int|auto)\s+\*?\s*(\w+)\s*=\s*',
}

#: Untrusted inputs of the property graph by language.
GRAPH_SOURCES = {
    'python': ('request.args', 'request.form', 'request.values', 'request.json', 'request.data', 'request.files', 'request.cookies', 'input(', 'sys.stdin', 'os.environ', 'request.GET', 'request.POST'),
    'javascript': ('req.body', 'req.query', 'req.params', 'req.headers', 'req.cookies', 'document.URL', 'document.documentURI', 'document.referrer', 'window.location', 'location.search', 'location.hash', 'process.argv', 'prompt('),
    'java': ('request.getParameter', 'request.getQueryString', 'request.getHeader', 'request.getCookies', 'System.in', 'Scanner.nextLine'),
    'php': ('$_GET', '$_POST', '$_REQUEST', '$_COOKIE', '$_SERVER', 'php://input', 'file_get_contents', 'fopen'),
    'go': ('r.FormValue', 'r.URL.Query', 'r.Header.Get', 'r.Body', 'bufio.Scanner'),
    'ruby': ('params[', 'request.params', 'request.headers', 'gets', 'STDIN.gets'),
    'generic': ('argv', 'stdin', 'env'),
}

#: Dangerous uses of the property graph by language.
GRAPH_SINKS = {
    'python': ('eval(', 'exec(', 'os.system(', 'os.popen(', 'subprocess.call(', 'subprocess.Popen(', 'subprocess.run(', 'pickle.load(', 'pickle.loads(', 'yaml.load(', 'marshal.load(', 'marshal.loads(', 'open(', 'render_template_string(', 'execute(', 'raw('),
    'javascript': ('eval(', 'Function(', 'setTimeout(', 'setInterval(', 'innerHTML', 'document.write(', 'document.writeln(', 'dangerouslySetInnerHTML', 'child_process.exec(', 'child_process.spawn(', 'execSync(', 'spawnSync(', 'require(', 'import('),
    'java': ('Runtime.exec(', 'ProcessBuilder(', 'ObjectInputStream.readObject(', 'Statement.execute(', 'Statement.executeQuery(', 'PreparedStatement.execute(', 'XPath.evaluate(', 'DocumentBuilder.parse('),
    'php': ('eval(', 'assert(', 'system(', 'exec(', 'passthru(', 'shell_exec(', 'popen(', 'proc_open(', 'unserialize(', 'include(', 'require(', 'include_once(', 'require_once(', 'file_get_contents(', 'file_put_contents(', 'mysqli_query(', 'mysql_query(', 'pg_query(', 'sqlite_query('),
    'go': ('exec.Command(', 'os/exec.', 'sql.Query(', 'sql.Exec(', 'template.HTML(', 'template.JS(', 'http.Get(', 'http.Post('),
    'ruby': ('eval(', 'system(', 'exec(', 'send(', 'render(', 'render inline:', 'send_file(', 'send_data(', 'open(', 'IO.read('),
    'generic': ('eval(', 'exec(', 'system(', 'popen(', 'execute(', 'query('),
}

#: Function definitions by language.
FUNCTION_PATTERNS = {
    'python': r'^\s*def\s+(\w+)\s*\(',
    'javascript': r'^\s*(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:function|\()|(?:async\s+)?function\s+(\w+))',
    'typescript': r'^\s*(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(?:function|\()|(?:async\s+)?function\s+(\w+))',
    'java': r'^\s*(?:public|private|protected|static|\s)*\s+\w+\s+(\w+)\s*\(',
    'go': r'^\s*func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)\s*\(',
    'rust': r'^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)',
    'php': r'^\s*(?:public|private|protected|\s)*\s*function\s+(\w+)',
    'ruby': r'^\s*(?:def)\s+(\w+)',
    'c_sharp': r'^\s*(?:public|private|protected|internal|\s)*\s+(?:static\s+)?(?:async\s+)?\w+\s+(\w+)\s*\(',
    'kotlin': r'^\s*(?:fun)\s+(\w+)',
    'swift': r'^\s*func\s+(\w+)',
    'lua': r'^\s*function\s+(\w+)',
    'perl': r'^\s*sub\s+(\w+)',
    'dart': r'^\s*(?:void|int|String|bool|Future|List|Map|\w+)\s+(\w+)\s*\(',
    'scala': r'^\s*(?:def)\s+(\w+)',
}

#: Assignments (groups: variable, value) by language.
ASSIGNMENT_PATTERNS = {
    'python': r'^\s*(\w+)\s*=\s*(.+)',
    'javascript': r'^\s*(?:const|let|var)\s+(\w+)\s*=\s*(.+)',
    'typescript': r'^\s*(?:const|let|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(.+)',
    'java': r'^\s*(?:\w+\s+)+(\w+)\s*=\s*(.+)',
    'go': r'^\s*(?::=)\s*(\w+)\s*=\s*(.+)',
    'php': r'^\s*\$\w+\s*=\s*(.+)',
    'ruby': r'^\s*(\w+)\s*=\s*(.+)',
    'c_sharp': r'^\s*(?:var|int|string|bool|\w+)\s+(\w+)\s*=\s*(.+)',
    'kotlin': r'^\s*(?:val|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(.+)',
    'swift': r'^\s*(?:let|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(.+)',
    'lua': r'^\s*(\w+)\s*=\s*(.+)',
    'perl': r'^\s*my\s+\$(\w+)\s*=\s*(.+)',
    'dart': r'^\s*(?:var|final|int|String|bool|\w+)\s+(\w+)\s*=\s*(.+)',
    'scala': r'^\s*(?:val|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(.+)',
}

#: Syntax-tree language by extension.
TREE_LANGUAGE_OF_EXT = {
    '.py': 'python',
    '.js': 'javascript',
    '.jsx': 'javascript',
    '.mjs': 'javascript',
    '.ts': 'typescript',
    '.tsx': 'typescript',
    '.java': 'java',
    '.go': 'go',
    '.rs': 'rust',
    '.c': 'c',
    '.h': 'c',
    '.cpp': 'cpp',
    '.hpp': 'cpp',
    '.cc': 'cpp',
    '.cxx': 'cpp',
    '.cs': 'c_sharp',
    '.php': 'php',
    '.rb': 'ruby',
    '.kt': 'kotlin',
    '.kts': 'kotlin',
    '.swift': 'swift',
    '.lua': 'lua',
    '.pl': 'perl',
    '.pm': 'perl',
    '.dart': 'dart',
    '.scala': 'scala',
    '.sol': 'solidity',
}

#: Syntax-tree node types that define a function.
TREE_FUNCTION_TYPES = (
    'function_definition', 'function_declaration', 'method_definition', 'method_declaration', 'arrow_function', 'function', 'constructor_declaration',
    'generator_function_declaration', 'func_literal', 'function_item',
)

#: Syntax-tree node types that define a class.
TREE_CLASS_TYPES = (
    'class_definition', 'class_declaration', 'interface_declaration', 'type_declaration', 'struct_declaration', 'enum_declaration',
    'trait_declaration', 'impl_item',
)

#: Syntax-tree node types that may join strings.
TREE_CONCAT_TYPES = (
    'concatenated_string', 'binary_operator', 'template_string', 'f_string', 'interpolated_string',
)

#: Syntax-tree parts of names of dangerous calls.
TREE_DANGEROUS_NAMES = (
    'eval', 'exec', 'system', 'popen', 'subprocess', 'os.system', 'os.popen', 'shell_exec', 'passthru', 'Runtime.exec', 'ProcessBuilder',
    'child_process', 'dangerouslySetInnerHTML', 'innerHTML', 'document.write', 'pickle.load', 'yaml.load', 'marshal.load', 'deserializ',
    'unserialize', 'marshal.loads', 'format', 'printf', 'sprintf',
)
# fmt: on
