"""Rule tables and word lists that ship with the engine."""

from __future__ import annotations

# File-name rules by stack: pattern, purpose, most lines, forbidden imports, message.
TAXONOMY = {
    "flutter-riverpod": [
        ("*_screen.dart", "Route entry — composes widgets, wires providers", 150, ["repository", "sqflite", "hive", "http", "dio", "supabase"], "Screens compose widgets and read providers. Data access belongs in a repository."),
        ("*_page.dart", "Route entry — alias for screen", 150, ["repository", "sqflite", "hive", "http", "dio", "supabase"], "Pages compose widgets and read providers. Data access belongs in a repository."),
        ("*_widget.dart", "Reusable UI component", 120, ["repository", "sqflite", "hive", "http", "dio"], "Widgets are presentational. Pass data via constructor or ref.watch."),
        ("*_provider.dart", "Riverpod provider — state and business logic", 200, ["flutter/material.dart", "flutter/widgets.dart", "sqflite", "hive"], "Providers hold logic, not UI. DB access belongs in a repository."),
        ("*_notifier.dart", "Riverpod Notifier — state machine", 200, ["flutter/material.dart", "flutter/widgets.dart", "sqflite", "hive"], "Notifiers hold state logic. DB access belongs in a repository."),
        ("*_repository.dart", "Data access layer — owns all network and storage calls", 300, ["flutter/material.dart", "flutter/widgets.dart"], "Repositories own data access. No UI imports allowed."),
        ("*_model.dart", "Pure data class", 150, ["flutter/material.dart", "sqflite", "hive", "http", "dio"], "Models are pure data. No UI or storage imports."),
    ],
    "flutter-bloc": [
        ("*_page.dart", "Route entry — wires BLoC + View", 80, ["repository", "sqflite", "hive", "http", "dio"], "Pages wire a BLoC to a View. No logic or data access here."),
        ("*_view.dart", "Widget tree — reads BLoC state", 200, ["repository", "sqflite", "hive", "http", "dio"], "Views render BLoC state. No business logic or data access."),
        ("*_bloc.dart", "State machine — no UI, no direct DB", 300, ["flutter/material.dart", "flutter/widgets.dart", "sqflite", "hive"], "Blocs manage state. DB access belongs in a repository."),
        ("*_cubit.dart", "Simplified BLoC", 200, ["flutter/material.dart", "flutter/widgets.dart", "sqflite", "hive"], "Cubits manage state. DB access belongs in a repository."),
        ("*_repository.dart", "Data access layer", 300, ["flutter/material.dart", "flutter/widgets.dart"], "Repositories own data access. No UI imports allowed."),
        ("*_model.dart", "Pure data class", 150, ["flutter/material.dart", "sqflite", "hive", "http", "dio"], "Models are pure data. No UI or storage imports."),
    ],
    "fastapi": [
        ("*_router.py", "HTTP handler — thin", 80, ["sqlalchemy", "psycopg2", "psycopg", "asyncpg"], "Routers call services. DB calls belong in a repository."),
        ("*_service.py", "Business logic", None, ["fastapi", "httpx", "requests"], "Services contain business logic. HTTP layer belongs in a router."),
        ("*_repository.py", "Data access only", None, ["fastapi"], "Repositories own data access. No HTTP framework imports."),
        ("*_schema.py", "Pydantic shapes — pure data", 150, ["sqlalchemy", "fastapi.routing"], "Schemas are pure data shapes. No DB or routing logic."),
    ],
    "axum": [
        ("*_handler.rs", "HTTP handler — thin", None, ["sqlx::query", "sqlx::pool", "Pool"], "Handlers are thin. DB calls belong in a repository."),
        ("*_service.rs", "Business logic — no HTTP, no SQL", None, ["axum::", "Request", "Response"], "Services contain business logic. HTTP types belong in handlers."),
        ("*_repository.rs", "Data access only", None, ["axum::"], "Repositories own data access. No HTTP framework imports."),
    ],
}

# Folder rules by stack: pattern, most files, required children, message.
FOLDERS = {
    "flutter-riverpod": [
        ("lib/pages", 0, [], "Flat lib/pages/ dump detected. Organize by feature: lib/features/<name>/presentation/."),
        ("lib/screens", 0, [], "Flat lib/screens/ dump detected. Organize by feature: lib/features/<name>/presentation/."),
        ("lib/features/*", 0, ["data", "domain", "presentation"], "Feature folders must contain data/, domain/, and presentation/ — not loose files."),
        ("lib/features/*/presentation", 12, [], "presentation/ is getting crowded. Consider splitting into sub-features."),
        ("lib/features/*/data", 8, [], "data/ is getting crowded. Consider splitting repositories by domain."),
        ("lib/features/*/domain", 8, [], "domain/ is getting crowded. Consider grouping models into sub-packages."),
        ("lib/core", 15, [], "lib/core/ is growing large. If it exceeds 15 files, logic is probably leaking into utilities."),
    ],
    "flutter-bloc": [
        ("lib/pages", 0, [], "Flat lib/pages/ dump. Organize by feature: lib/features/<name>/."),
        ("lib/features/*", 0, ["bloc", "data", "view"], "Feature folders must contain bloc/, data/, and view/ — not loose files."),
        ("lib/features/*/view", 10, [], "view/ is getting crowded. Consider splitting into sub-features."),
        ("lib/core", 15, [], "lib/core/ is growing large."),
    ],
    "fastapi": [
        ("src/routers", 15, [], "routers/ is growing. Consider grouping by domain into sub-packages."),
        ("src/services", 15, [], "services/ is growing. Consider grouping by domain."),
        ("src/repositories", 15, [], "repositories/ is growing. Consider grouping by domain."),
    ],
    "axum": [
        ("src/handlers", 15, [], "handlers/ is growing. Consider grouping by domain module."),
        ("src/services", 15, [], "services/ is growing. Consider splitting into domain modules."),
    ],
}

# Content rules by preset: name, path pattern, forbidden literals, severity, message.
CONTENT = {
    "flutter": [
        ("no-print-in-prod", "lib/**/*.dart", ["print("], "error", "Use a logger (package:logging or similar). print() is not stripped in release builds."),
        ("no-inline-mock-data", "lib/**/*.dart", ["MockData(", "FakeData(", "DummyData(", "fakeUser", "dummyUser", "testUser", "mockUser", "hardcodedToken", "fake_token", "test_token"], "error", "Mock data belongs in test fixtures, not production code."),
        ("no-hardcoded-urls", "lib/**/*.dart", ["'http://", '"http://', "'https://", '"https://'], "error", "URLs belong in a config file or environment constants, not inlined."),
        ("no-localhost", "lib/**/*.dart", ["localhost:", "127.0.0.1", "0.0.0.0"], "error", "Localhost references must not ship in production code."),
        ("no-todo-in-prod", "lib/**/*.dart", ["// TODO", "// FIXME", "// HACK", "// XXX"], "warning", "Resolve before shipping."),
        ("no-debug-flags", "lib/**/*.dart", ["kDebugMode && print", "debugPrint(", "assert(false"], "warning", "Remove debug-only code paths before release."),
        ("no-inline-box-decoration", "lib/**/*.dart", ["BoxDecoration("], "warning", "Extract BoxDecoration to a theme extension or a named const style variable."),
        ("no-inline-opacity", "lib/**/*.dart", [".withValues(alpha:", ".withOpacity("], "warning", "Use a named color token from your theme instead of inline alpha/opacity."),
        ("no-raw-border-radius", "lib/**/*.dart", ["BorderRadius.circular(", "BorderRadius.only(", "BorderRadius.all("], "warning", "Use theme radius tokens (e.g. theme.radii.*) instead of hardcoded BorderRadius."),
        ("no-raw-edge-insets", "lib/**/*.dart", ["EdgeInsets.symmetric(", "EdgeInsets.all(", "EdgeInsets.only(", "EdgeInsets.fromLTRB("], "warning", "Use theme spacing tokens instead of hardcoded EdgeInsets."),
        ("no-hardcoded-colors", "lib/**/*.dart", ["Colors.red", "Colors.blue", "Colors.green", "Colors.black", "Colors.white", "Colors.grey", "Color(0x", "Color.fromARGB(", "Color.fromRGBO("], "warning", "Use theme.colorScheme.* instead of hardcoded colors."),
        ("no-inline-text-style", "lib/**/*.dart", ["TextStyle(fontSize:", "TextStyle(fontWeight:", "TextStyle(color:", "TextStyle(fontFamily:"], "warning", "Use theme.textTheme.* instead of inline TextStyle."),
        ("no-imperative-navigation", "lib/**/*.dart", ["Navigator.of(context).push", "Navigator.push(", "Navigator.pushNamed(", "Navigator.pop("], "warning", "Use a declarative router (go_router / auto_route) instead of Navigator directly."),
        ("no-media-query-size", "lib/**/*.dart", ["MediaQuery.of(context).size", "MediaQuery.of(context).width", "MediaQuery.of(context).height"], "warning", "Use MediaQuery.sizeOf(context) — the .of() accessor rebuilds on any MediaQuery change."),
        ("no-null-bang", "lib/**/*.dart", ["!;", "! ,", "! )", "!,\n", "!)"], "warning", "Avoid the null-bang operator (!). Use null-safe patterns, early returns, or provide a fallback."),
        ("no-future-delayed-zero", "lib/**/*.dart", ["Future.delayed(Duration.zero", "Future.delayed(const Duration()"], "warning", "Future.delayed(Duration.zero) is a frame-defer hack. Fix the lifecycle issue instead (use addPostFrameCallback)."),
        ("no-raw-sized-box-spacing", "lib/**/*.dart", ["SizedBox(height:", "SizedBox(width:"], "warning", "Use AppSpacing.hMd / AppSpacing.wSm etc. instead of hardcoded SizedBox dimensions."),
        ("no-theme-of-context", "lib/**/*.dart", ["Theme.of(context)"], "warning", "Use context.colorScheme / context.textTheme from core/extensions/context_x.dart instead."),
        ("no-raw-duration", "lib/**/*.dart", ["Duration(milliseconds:", "Duration(seconds:", "Duration(minutes:"], "warning", "Use AppDurations.medium2 etc. instead of hardcoded Duration literals."),
    ],
    "python": [
        ("no-print-debug", "src/**/*.py", ["print("], "warning", "Use logging instead of print() in production code."),
        ("no-hardcoded-secrets", "**/*.py", ["password =", "secret =", "api_key =", "API_KEY =", "SECRET_KEY =", "token ="], "error", "Secrets must not be hardcoded. Use environment variables or a secrets manager."),
        ("no-bare-except", "**/*.py", ["except:"], "error", "Bare except catches everything including KeyboardInterrupt. Catch specific exceptions."),
        ("no-inline-mock-data", "src/**/*.py", ["mock_data", "fake_data", "dummy_data", "test_token", "fake_token"], "error", "Mock data belongs in test fixtures, not production code."),
        ("no-todo-in-prod", "src/**/*.py", ["# TODO", "# FIXME", "# HACK"], "warning", "Resolve before shipping."),
    ],
    "rust": [
        ("no-unwrap-in-prod", "src/**/*.rs", [".unwrap()", ".expect("], "warning", "Prefer proper error handling over unwrap/expect in production paths."),
        ("no-todo-macro", "src/**/*.rs", ["todo!(", "unimplemented!(", "panic!("], "error", "todo!/unimplemented!/panic! must not ship in production."),
        ("no-println-in-prod", "src/**/*.rs", ["println!(", "dbg!(", "eprintln!("], "warning", "Use the tracing or log crate instead of println!/dbg!."),
        ("no-hardcoded-secrets", "src/**/*.rs", ['password = "', 'secret = "', 'api_key = "', 'token = "'], "error", "Secrets must not be hardcoded."),
    ],
    "general": [
        ("no-todo-in-prod", "**/*", ["TODO", "FIXME", "HACK"], "warning", "Resolve before shipping."),
        ("no-hardcoded-secrets", "**/*", ["password=", "secret=", "api_key=", "apikey=", "access_token="], "error", "Secrets must not be hardcoded."),
    ],
}

# Languages by file suffix.
LANGUAGES = {".py": "python", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".dart": "dart"}

# Path components that are not scanned, for files and for folders.
IGNORED = ["__pycache__", ".venv", "venv", "env", ".env", "node_modules", "dist", "build", "target", ".git", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".dart_tool", ".flutter-plugins", ".flutter-plugins-dependencies", "ephemeral", "GeneratedPluginRegistrant"]
IGNORED_FOLDERS = ["__pycache__", ".dart_tool", "build", "dist", "node_modules", ".git", "target"]

# Path components of tests.
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__"]

# Test types by marker, by part of a path component and by imported package.
TEST_MARKERS = {"pytest.mark.integration": "integration", "pytest.mark.e2e": "e2e", "pytest.mark.smoke": "smoke", "pytest.mark.security": "security", "pytest.mark.slow": "integration"}
TEST_PATHS = {"unit": "unit", "integration": "integration", "e2e": "e2e", "end_to_end": "e2e", "smoke": "smoke", "security": "security", "sec": "security"}
TEST_IMPORTS = {"playwright": "e2e", "selenium": "e2e", "cypress": "e2e", "puppeteer": "e2e", "psycopg2": "integration", "sqlalchemy": "integration", "pymongo": "integration", "redis": "integration", "boto3": "integration", "httpx": "integration", "requests": "integration", "bandit": "security", "safety": "security"}
TEST_TYPES = ["unit", "integration", "e2e", "smoke", "security", "unknown"]

# Names that are alive without a reference.
ENTRY_POINTS = ["main", "app", "run", "handler", "create_app", "make_app", "setup", "teardown", "pytest_configure", "pytest_sessionstart"]

# Name prefixes of calls that make a function observable, by language, and calls that never do.
OBSERVED = {
    "python": ["logging", "logger", "log", "structlog", "tracer", "span", "meter", "counter", "histogram", "sentry_sdk", "capture_exception", "capture_message"],
    "dart": ["Logger", "_log", "log", "Sentry", "captureException", "captureMessage", "recordError", "recordFlutterFatalError", "FirebaseCrashlytics", "FirebasePerformance", "tracer", "span", "startSpan", "startActiveSpan", "setAttribute", "addEvent", "recordException", "globalTracerProvider", "getTracer", "_telemetry", "telemetry", "recordClientWrite", "recordClientRead", "_recordOtelSpan", "_otelSpan"],
    "rust": ["tracing", "log", "info", "warn", "error", "debug", "trace", "span", "instrument"],
    "typescript": ["logger", "log", "Sentry", "captureException", "captureMessage", "tracer", "span", "meter", "console"],
    "javascript": ["logger", "log", "Sentry", "captureException", "captureMessage", "tracer", "span", "meter", "console"],
}
NOT_OBSERVED = ["print", "debugPrint", "println", "console.log", "fmt.Print", "fmt.Println"]

# Layers by class-name suffix, first suffix that fits.
ARCHETYPES = {"Widget": "ui", "Page": "ui", "Screen": "ui", "View": "ui", "Shell": "ui", "Dialog": "ui", "Sheet": "ui", "Bloc": "state", "Cubit": "state", "Notifier": "state", "Controller": "state", "Provider": "state", "ViewModel": "state", "Repository": "data", "DataSource": "data", "Adapter": "data", "Dao": "data", "Service": "service", "UseCase": "service", "Interactor": "service", "Client": "infra", "Api": "infra", "Cache": "infra"}
DATA_IMPORTS = ["dio", "sqflite", "hive", "drift", "isar", "http", "chopper"]

# Limits of large files and classes.
MAX_LOC, MAX_CALLABLES, MAX_CLASSES, MAX_METHODS = 500, 20, 5, 15
