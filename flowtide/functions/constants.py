"""Word lists, patterns and formats that results depend on."""

# --- Node id prefixes -------------------------------------------------------
NODE_PREFIX = {
    "IRFunction": "FUNC",
    "IRCall": "CALL",
    "IRVar": "VAR",
    "IRAccess": "ACCESS",
    "IRBranch": "BRANCH",
    "IRLiteral": "LIT",
    "IRAssign": "ASSIGN",
    "IRReturn": "RET",
    "IRCallExpr": "CALLE",
}

# Label shown for a node that no index knows, by id prefix.
PREFIX_LABEL = {
    "VAR": "variable",
    "ACCESS": "property access",
    "CALLE": "call expression",
    "CALL": "function call",
    "ASSIGN": "assignment",
    "LIT": "literal value",
    "RET": "return statement",
    "FUNC": "function definition",
    "BRANCH": "conditional branch",
}

# --- File paths -------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TSX",
    ".go": "Go",
    ".rs": "Rust",
    ".java": "Java",
    ".cs": "C#",
    ".c": "C",
    ".cpp": "C++",
    ".cc": "C++",
    ".h": "C++",
    ".hpp": "C++",
    ".php": "PHP",
    ".rb": "Ruby",
    ".kt": "Kotlin",
    ".swift": "Swift",
}

PROJECT_LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".vue": "Vue.js",
    ".java": "Java",
    ".go": "Go",
    ".rs": "Rust",
    ".php": "PHP",
    ".rb": "Ruby",
    ".cs": "C#",
    ".c": "C",
    ".h": "C / C++",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".kt": "Kotlin",
    ".swift": "Swift",
    ".tf": "Terraform",
    ".sh": "Shell",
}

LANGUAGE_MARKERS = {
    "Node.js": ["package.json", "yarn.lock", "pnpm-lock.yaml"],
    "Python": ["requirements.txt", "setup.py", "pyproject.toml", "setup.cfg", "Pipfile", "Pipfile.lock"],
    "Java": ["pom.xml", "build.gradle", "settings.gradle", "gradlew"],
    "Go": ["go.mod", "go.sum"],
    "Rust": ["Cargo.toml", "Cargo.lock"],
    "PHP": ["composer.json", "composer.lock"],
    "Ruby": ["Gemfile", "Gemfile.lock"],
    ".NET (C#)": ["*.sln", "*.csproj"],
    "C / C++": ["CMakeLists.txt", "Makefile", "configure.ac"],
    "Kotlin": ["build.gradle.kts"],
    "Swift": ["Package.swift"],
    "Terraform": ["*.tf"],
    "Docker": ["Dockerfile", "docker-compose.yml"],
}

LANGUAGE_PRIORITY = ["Node.js", "Python", "Java", "Go", "Rust", "PHP", "Ruby", ".NET (C#)", "C / C++"]

# Framework -> any of: dep (part of a dependency name), file, ext (file suffix).
FRAMEWORK_CHECKS = [
    ("Django", {"file": ["manage.py"], "dep": ["django"]}),
    ("Flask", {"dep": ["flask"]}),
    ("FastAPI", {"dep": ["fastapi"]}),
    ("Pyramid", {"dep": ["pyramid"]}),
    ("React", {"dep": ["react"], "ext": ["jsx", "tsx"]}),
    ("Vue.js", {"dep": ["vue"], "ext": ["vue"]}),
    ("Angular", {"file": ["angular.json"], "dep": ["@angular/core"]}),
    ("Next.js", {"dep": ["next"]}),
    ("Nuxt.js", {"dep": ["nuxt"]}),
    ("Express", {"dep": ["express"]}),
    ("NestJS", {"dep": ["@nestjs/core"]}),
    ("Electron", {"dep": ["electron"]}),
    ("Spring Boot", {"dep": ["spring-boot-starter"], "file": ["spring-boot-starter"]}),
    ("Laravel", {"file": ["artisan"], "dep": ["laravel/framework"]}),
    ("Symfony", {"dep": ["symfony/symfony", "symfony/framework-bundle"]}),
    ("Rails", {"dep": ["rails"], "file": ["config/routes.rb"]}),
    ("Gin", {"dep": ["gin-gonic/gin"]}),
    ("Echo", {"dep": ["labstack/echo"]}),
    ("Fiber", {"dep": ["gofiber/fiber"]}),
    ("Actix Web", {"dep": ["actix-web"]}),
    ("Rocket", {"dep": ["rocket"]}),
    ("Axum", {"dep": ["axum"]}),
    ("Tokio", {"dep": ["tokio"]}),
]

PACKAGE_SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]
DEPENDENCY_TEXT_FILES = [
    "pyproject.toml", "setup.py", "Cargo.toml", "go.mod", "composer.json", "Gemfile", "build.gradle",
]

PRUNED_DIRECTORIES = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode",
]
PARSE_DEPTH = 5
LANGUAGE_THRESHOLD = 3

VENDOR_PARTS = ["/node_modules/", "/vendor/", "/assets/private/", "/dist/", "/build/output/"]
VENDOR_SUFFIXES = [".min.js", ".min.css", ".bundle.js"]
TEST_PARTS = ["/cypress/", "/test/", "/tests/", "/__tests__/", "/spec/", "/specs/"]
TEST_NAME_PARTS = [
    ".spec.", ".test.", "cypress.config", "jest.config", "playwright.config", "vitest.config",
]
FIXTURE_PARTS = ["/codefixes/", "/data/static/", "/static/codefixes/", "/fixtures/"]
BUILD_NAMES = [
    "gruntfile.js", "gulpfile.js", "webpack.config.js", "vite.config.js", "vite.config.ts",
    "rollup.config.js", "next.config.js", "next.config.mjs",
]
CLIENT_PARTS = ["/frontend/", "/client/", "/src/app/", "/public/"]

NON_RUNTIME_PARTS = [
    "/cypress/", "/test/", "/tests/", "/__tests__/", "/spec/", "/specs/", "/assets/private/",
    "/node_modules/", "/vendor/", "/dist/", "/codefixes/", "/data/static/", "/static/codefixes/",
]
NON_RUNTIME_SUFFIXES = [".spec.ts", ".spec.js", ".test.ts", ".test.js", ".min.js", ".bundle.js"]
NON_RUNTIME_NAMES = [
    "gruntfile.js", "gulpfile.js", "cypress.config.ts", "cypress.config.js", "jest.config.js",
    "webpack.config.js", "vite.config.ts",
]

BACKEND_PARTS = [
    "/api/", "/server/", "/routes/", "/controllers/", "/middleware/",
    "route.ts", "route.js", "route.tsx", "server.", "api.", "db.", "schema.",
]
FRONTEND_PARTS = [
    "/components/", "/pages/", "/app/", "/views/", ".tsx", ".jsx",
    "component.", "page.", "layout.", "client.",
]

ROUTE_FILE_PATTERN = r"(/api/|/routes/|route\.(ts|js|tsx)$|/pages/api/)"
ROUTE_TAIL_PATTERN = r"(?:/api/|/routes/)(.+)"

IR_LANGUAGES = ["TypeScript", "JavaScript", "TSX"]
IR_SKIPPED_ROLES = ["VENDOR", "BUILD", "TEST"]

# --- Names ------------------------------------------------------------------
NOISE_NAMES = ["async", "function", "export", "default", "anonymous", "lambda", "handler", ""]
AUTH_NAME_PARTS = ["auth", "jwt", "token", "session", "middleware", "guard", "authenticate", "authorize"]

# --- Calls ------------------------------------------------------------------
SINK_GLOBS = [
    ("SINK_SHELL", 0.90, [
        "*child_process*", "*execsync*", "*execfile*", "*popen*", "*system*", "eval", "spawn", "exec",
    ]),
    ("SINK_DATABASE", 0.85, [
        "*db.query*", "*db.raw*", "*db.execute*", "*db.executesql*", "*prisma*", "*knex*",
        "*mongoose*", "*sequelize*", "*$transaction*", "*$execute*", "*$queryrawunsafe*",
        "*sql.raw*", "*.findunique*", "*.findmany*", "*.findfirst*", "*.findone*", "*.findbyid*",
        "*.findbypk*", "*.createmany*", "*.updatemany*", "*.deletemany*", "*.upsert*",
        "*.executesql*", "*.insert*", "*$where*", "*mapreduce*", "queryresulttojson",
        "db.query", "db.execute", "db.insert", "db.update", "db.delete",
    ]),
    ("SINK_FILE", 0.85, [
        "*readfile*", "*writefile*", "*openfile*", "*unlink*", "*readdir*", "*fs.*", "*sendfile*",
        "*download*", "*createreadstream*", "*createwritestream*",
    ]),
    ("SINK_XSS", 0.85, [
        "*dangerouslysetinnerhtml*", "*innerhtml*", "*outerhtml*", "*document.write*",
        "*res.send*", "*res.write*", "*res.render*",
    ]),
    ("SINK_NETWORK", 0.85, [
        "*fetch*", "*axios*", "*ajax*", "*http.*", "*https.*", "*got*", "*superagent*", "*undici*",
    ]),
]

NON_SINK_METHODS = [
    "find", "filter", "map", "foreach", "reduce", "some", "every",
    "includes", "indexof", "create", "assign", "keys", "values",
    "parse", "stringify", "slice", "splice", "push", "pop", "shift", "unshift",
    "split", "join", "format", "replace", "concat", "match", "substring", "trim",
    "normalize", "sub", "transform", "settransform", "uniform1f", "uniform1i",
    "uniform2f", "uniform3f", "uniform4f", "uniform1fv", "uniform2fv", "uniform3fv",
    "uniform4fv", "uniform1iv", "uniform3iv", "uniformmatrix3fv", "uniformmatrix4fv",
    "computemorphnormals", "getnormalmatrix", "bufferguessnormaltype",
    "refreshuniformsfog", "refreshuniformslights", "refreshuniformscommon",
    "refreshuniformsline", "refreshuniformsdash", "refreshuniformsparticle",
    "refreshuniformsphong", "refreshuniformslambert", "refreshuniformsshadow",
    "loaduniformsgeneric", "loaduniformsmatrices",
    "queryselector", "queryselectorall", "getelementbyid", "getelementsbyclassname",
    "getelementsbytagname", "fromqueryparams", "geterrormessage", "streamtext",
    "checkifllmmodelavailable", "buildsystemprompt",
]
DATABASE_ROOTS = ["db", "prisma", "knex", "repo", "repository", "sequelize", "mongoose"]

SINK_TAG_NAMES = [
    "exec", "spawn", "popen", "system", "fork", "execSync", "execFile", "eval",
    "query", "findUnique", "findMany", "create", "update", "delete", "upsert",
    "$executeRawUnsafe", "$queryRawUnsafe", "$transaction", "createMany", "updateMany",
    "sequelize.query", "queryresulttojson", "sql.raw", "raw", "executesql", "$where", "mapreduce",
    "writeFile", "writeFileSync", "readFile", "readFileSync", "unlink", "appendFile",
    "sendfile", "download", "createreadstream", "createwritestream",
    "send", "write", "render", "dangerouslysetinnerhtml", "innerhtml", "outerhtml", "document.write",
    "fetch", "http.request", "https.request", "redirect", "permanentredirect",
]
SINK_TAG_PREFIXES = ["prisma", "axios", "got", "undici"]

SOURCE_ROOTS = [
    "req", "request", "event", "ctx", "c", "payload", "input", "body", "query", "params",
    "headers", "cookies", "searchparams", "msg", "props", "url", "astro", "nexturl",
]
SOURCE_FIRST_PART = [
    (["body", "json", "payload", "data"], "SOURCE_HTTP_BODY"),
    (["params", "param"], "SOURCE_URL_PARAM"),
    (["query", "searchparams", "url"], "SOURCE_URL_QUERY"),
    (["cookies", "cookie"], "COOKIE"),
    (["headers", "header"], "AUTH_HEADER"),
]
SESSION_ROOTS = ["session", "auth"]
BODY_READERS = ["json", "body", "text"]

SOURCE_TAGS = [
    "HTTP_BODY", "HTTP_PARAMS", "FILE_READ", "ENV_VAR", "COOKIE", "AUTH_HEADER",
    "SOURCE_HTTP_BODY", "SOURCE_URL_PARAM", "SOURCE_URL_QUERY", "SOURCE_SESSION", "SOURCE_ENV",
]
SUMMARY_SOURCE_TAGS = [
    "HTTP_BODY", "HTTP_PARAMS", "SOURCE_HTTP_BODY", "SOURCE_URL_PARAM", "SOURCE_URL_QUERY",
    "SOURCE_SESSION", "SOURCE_ENV",
]
OPERATION_TAGS = ["OP_COERCION", "OP_VALIDATION", "OP_AUTH"]
GATE_TAG = "VALIDATION_GATE"

TAG_ROLES = [
    ("HTTP_BODY", "source"),
    ("HTTP_PARAMS", "source"),
    ("SOURCE_HTTP_BODY", "source"),
    ("SOURCE_URL_PARAM", "source"),
    ("SOURCE_URL_QUERY", "source"),
    ("SOURCE_SESSION", "source"),
    ("SOURCE_ENV", "source"),
    ("FILE_READ", "source"),
    ("ENV_VAR", "source"),
    ("COOKIE", "source"),
    ("AUTH_HEADER", "source"),
    ("SINK_DATABASE", "database"),
    ("SINK_SQL", "database"),
    ("SINK_SHELL", "shell_exec"),
    ("SINK_EXEC", "shell_exec"),
    ("SINK_FILE", "file_op"),
    ("SINK_NETWORK", "external_req"),
    ("VALIDATION", "validation"),
    ("VALIDATION_GATE", "validation"),
    ("AUTH", "auth"),
    ("ROUTE", "endpoint"),
]

RECEIVER_TYPES = {
    "prisma": "PRISMA_CLIENT",
    "req": "EXPRESS_REQUEST",
    "request": "EXPRESS_REQUEST",
    "res": "EXPRESS_RESPONSE",
    "response": "EXPRESS_RESPONSE",
    "event": "AWS_LAMBDA_EVENT",
    "ctx": "AWS_LAMBDA_CONTEXT",
    "fs": "FS_MODULE",
    "path": "PATH_MODULE",
    "child_process": "CHILD_PROCESS",
    "axios": "AXIOS",
}

# --- Rules and review -------------------------------------------------------
CONCAT_PARTS = ["+", ".concat", "format", 'f"', "f'", "%s", "${"]
PATH_PARTS = ["+", "join", "resolve", "/", "\\", "path", "file"]
DATABASE_WRITE_PARTS = ["create", "insert", "update", "delete", "upsert", "save"]
DATABASE_SINKS = ["SINK_DATABASE", "SINK_SQL"]
FLOW_RULES = [
    "unvalidated-source-to-sink", "sql-injection-via-concat", "path-traversal",
    "ssrf-dynamic-url", "database-write-without-validation",
]
SEVERITY_ORDER = ["high", "medium", "low"]

SAFE_SINKS = [
    "console.log", "print", "printf", "fmt.Println", "logger.info",
    "logger.debug", "log.Info", "log.Debug", "os.Stdout.WriteString",
]
SAFE_SINK_TYPES = ["log", "print", "debug"]
SAFE_SOURCE_PREFIXES = ["os.environ.get", "os.getenv", "env(", "config("]

CALL_PATH_DEPTH = 10
EXCERPT_CHARS, EXCERPT_CONTEXT, EXCERPT_HEAD = 4000, 15, 20
BODY_CHARS, BODY_MARKER = 1000, "... [TRUNCATED]"
CACHE_LIMIT, CACHE_EVICT = 500, 100
RETRY_BASE, RETRY_CAP = 1.0, 30.0
TRUE_WORDS = ["true", "1", "yes", "on", "enable", "enabled"]
