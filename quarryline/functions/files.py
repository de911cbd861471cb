"""What a repository's file is, by its place, name, mode, size and first bytes: ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of folders, files and extensions that tell a class.
VENDOR_DIRS = "node_modules vendor bower_components Pods .git jspm_packages .yarn Carthage third_party thirdparty".split()
GENERATED_DIRS = "obj dist build target out .next coverage generated .angular .nuxt .dart_tool .gradle __pycache__ .terraform DerivedData".split()
GENERATED_NAMES = "*.g.cs *.g.i.cs *.Designer.cs *.designer.cs *.pb.go *_pb2.py *_pb2_grpc.py *.generated.cs *.g.dart *.freezed.dart *ModelSnapshot.cs".split()
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml packages.lock.json Podfile.lock pubspec.lock composer.lock poetry.lock Pipfile.lock gradle.lockfile Cargo.lock go.sum npm-shrinkwrap.json bun.lockb Gemfile.lock Package.resolved uv.lock".split()
MINIFIED_NAMES = "*.min.js *.min.css *.map *.min.mjs *-min.js *.bundle.js".split()
BINARY_EXTENSIONS = "png jpg jpeg gif ico webp bmp tif tiff pdf zip gz tgz tar rar 7z jar war ear dll exe so dylib class woff woff2 ttf eot otf mp4 mp3 wav mov avi keystore jks p12 pfx apk ipa aar nupkg snk pdb xlsx xls docx doc pptx ppt psd ai sketch heic db sqlite bin dat pyc o a lib cer der crt".split()
ASSET_DIRS = "assets static public wwwroot images img fonts icons".split()
#: extensions that make no asset of a file among assets
SETTING_EXTENSIONS = "json yml yaml xml config toml ini properties txt md webmanifest".split()
CODE_EXTENSIONS = "cs java kt kts ts tsx js jsx mjs cjs py dart swift m mm h php go rb rs sql sh bash ps1 psm1 bat cmd html htm cshtml razor vue scss sass css less xaml gradle groovy scala c cpp hpp vb fs aspx ascx asax master ashx asmx svc jsp ejs hbs pug twig plsql pls pks pkb r lua pl".split()
CONTRACT_NAMES = "openapi*.json openapi*.yaml openapi*.yml swagger*.json swagger*.yaml swagger*.yml *.proto *.graphql *.gql *.wsdl *.postman_collection.json *postman_collection*.json *.raml asyncapi*.json asyncapi*.yaml asyncapi*.yml *.openapi.json *.openapi.yaml *.swagger.json *.http".split()
INFRA_NAMES = "Dockerfile* *.Dockerfile *.dockerfile docker-compose*.yml docker-compose*.yaml compose*.yml compose*.yaml .dockerignore *.tf *.tfvars *.bicep *.bicepparam azure-pipelines*.yml azure-pipelines*.yaml Jenkinsfile* .gitlab-ci.yml bitbucket-pipelines.yml Chart.yaml nginx*.conf Procfile buildspec*.yml buildspec*.yaml appspec.yml cloudbuild*.yaml skaffold*.yaml kustomization.yaml serverless*.yml *.azcli template.yaml app.yaml vercel.json netlify.toml firebase.json web.config.transform".split()
INFRA_DIRS = "helm charts k8s kubernetes manifests deploy deployment deployments .azure pipelines .pipelines terraform infra infrastructure bicep arm .circleci ci .devops devops".split()
#: what both stands in a file that describes a cluster
CLUSTER_WORDS = ("apiVersion:", "kind:")
MANIFEST_NAMES = "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts package.json pubspec.yaml Podfile Package.swift pyproject.toml setup.py setup.cfg Pipfile composer.json Directory.Build.props Directory.Build.targets Directory.Packages.props nuget.config NuGet.Config NuGet.config global.json gradle.properties angular.json go.mod Cargo.toml Gemfile Makefile packages.config lerna.json nx.json workspace.json turbo.json pnpm-workspace.yaml gradle-wrapper.properties mvnw gradlew mvnw.cmd gradlew.bat webpack.config.js vite.config.ts vite.config.js next.config.js next.config.mjs next.config.ts babel.config.js .babelrc metro.config.js proxy.conf.json karma.conf.js jest.config.js jest.config.ts dotnet-tools.json *.csproj *.sln *.fsproj *.vbproj *.sqlproj requirements*.txt tsconfig*.json *.nuspec *.podspec".split()
TEST_DIRS = "test tests __tests__ spec specs e2e integration-tests testing UnitTests IntegrationTests androidTest cypress".split()
TEST_DIR_ENDS = "*.Tests *.Test *Tests *.UnitTests *.IntegrationTests".split()
TEST_NAMES = "*.spec.* *.test.* *Tests.cs *Test.cs *Test.java *Tests.java *IT.java *_test.py test_*.py *_test.dart *Test.kt *Tests.swift *_test.go *.Tests.csproj".split()
DOC_EXTENSIONS = "md rst adoc txt markdown".split()
DOC_NAMES = "README* CHANGELOG* LICENSE* CONTRIBUTING* NOTICE* AUTHORS* CODEOWNERS SECURITY* HISTORY*".split()
CONFIG_NAMES = "appsettings*.json web.config Web.config app.config App.config *.properties application*.yml application*.yaml bootstrap*.yml bootstrap*.yaml .env* *.env *.ini *.toml *.conf *.cfg *.xml host.json local.settings.json *.plist environment*.ts .eslintrc* .editorconfig .prettierrc* .gitignore .gitattributes .npmrc .nvmrc .browserslistrc launchSettings.json *.config *.yml *.yaml *.json *.json5 .htaccess *.settings *.runsettings *.ruleset .stylelintrc* *.xcconfig *.entitlements *.pubxml *.resx *.props *.targets *.xsd *.jsonc .flutter-plugins* .metadata .prettierignore .eslintignore .dockerignore .gcloudignore *.iml .tool-versions".split()
CONFIG_DIRS = "config configs conf settings environments properties".split()
#: language: extensions
LANGUAGES = {
    "csharp": "cs", "java": "java", "kotlin": "kt kts", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "python": "py", "dart": "dart", "swift": "swift", "objc": "m mm", "c": "h c", "php": "php", "go": "go", "ruby": "rb", "rust": "rs", "sql": "sql plsql pls pks pkb", "shell": "sh bash", "powershell": "ps1 psm1", "batch": "bat cmd",
    "html": "html htm ejs hbs pug", "razor": "cshtml razor", "vue": "vue", "scss": "scss sass", "css": "css", "less": "less", "xaml": "xaml", "groovy": "gradle groovy", "scala": "scala", "cpp": "cpp hpp", "vbnet": "vb", "fsharp": "fs", "aspnet": "aspx ascx asax master ashx asmx svc", "jsp": "jsp", "yaml": "yaml yml", "json": "json",
    "xml": "xml csproj fsproj vbproj props targets config plist wsdl xsd resx", "markdown": "md", "rst": "rst", "asciidoc": "adoc", "text": "txt", "hcl": "tf tfvars hcl", "bicep": "bicep", "proto": "proto", "graphql": "graphql gql", "properties": "properties", "ini": "ini", "toml": "toml", "conf": "conf", "dotenv": "env", "svg": "svg", "sln": "sln", "raml": "raml", "r": "r", "lua": "lua", "perl": "pl", "csv": "csv",
}
NAMED_LANGUAGES = {"Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "Makefile": "make", "Podfile": "ruby", "Gemfile": "ruby", "Procfile": "procfile"}
#: modes of links to other files and to other repositories; classes whose files aren't read
LINK_MODE, MODULE_MODE = "120000", "160000"
SKIPPED = ("vendor", "generated", "binary", "lockfile", "minified", "asset", "large", "symlink", "submodule")
LARGEST = 1_000_000


def one_of(names: list[str]) -> str:
    """A pattern for whole names that any of the globs matches (a star is any signs)."""
    return "^(" + "|".join(".*".join(re.escape(part) for part in n.split("*")) for n in names) + ")$"


def _in(values: Column, names: list[str]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, names)))


def extension(name: Column) -> Column:
    """What follows a name's last dot, lower case; none if only dots at the front are there."""
    return F.when(F.ltrim(name, F.lit(".")).contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def language_of(path: Column) -> Column:
    """The language of a file by its name, or else its extension; unknown for none."""
    name = F.substring_index(path, "/", -1)
    known = F.create_map(*[F.lit(x) for tongue, ends in LANGUAGES.items() for end in ends.split() for x in (end, tongue)])
    by_name = F.create_map(*[F.lit(x) for pair in NAMED_LANGUAGES.items() for x in pair])
    docker = name.startswith("Dockerfile") | name.endswith(".Dockerfile")
    return F.coalesce(by_name[name], F.when(docker, "dockerfile"), F.when(name.startswith(".env"), "dotenv"), known[extension(name)], F.lit("unknown"))


def classify_file(path: Column, size: Column, mode: Column | None = None, head: Column | None = None, largest: int = LARGEST) -> Column:
    """STRUCT<class, language, status> of a file (path, bytes, mode in octal, first bytes) by the
    first rule that it meets; without mode or first bytes, and for null ones, rules about them
    aren't met.  Files of some classes are skipped, all others pending."""
    mode = F.lit("") if mode is None else F.coalesce(mode, F.lit(""))
    head = F.lit("") if head is None else F.coalesce(F.decode(head, "ISO-8859-1"), F.lit(""))
    parts = F.split(path, "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    low, end = F.transform(dirs, F.lower), extension(name)
    named, ends = (lambda names: name.rlike(one_of(names))), (lambda names: end.isin(names))
    setting = ends(SETTING_EXTENSIONS) | name.startswith(".")
    cluster = F.contains(head, F.lit(CLUSTER_WORDS[0])) & F.contains(head, F.lit(CLUSTER_WORDS[1]))
    yaml = end.isin("yml", "yaml")
    infra = named(INFRA_NAMES) | path.startswith(".github/workflows/") | path.startswith(".github/actions/") | (yaml & (_in(low, INFRA_DIRS) | cluster)) | (_in(low, ["helm", "charts", "terraform"]) & end.isin("tpl", "tf", "json", "yaml"))
    tested = F.exists(dirs, lambda d: d.rlike(one_of(TEST_DIR_ENDS)))
    rules = (
        ("submodule", mode == MODULE_MODE),
        ("symlink", mode == LINK_MODE),
        # a folder of restored packages has a version in its name
        ("vendor", _in(dirs, VENDOR_DIRS) | path.rlike(r"(^|/)packages/[^/]+\.\d+(\.\d+)+[^/]*/") | F.contains(path, F.lit("wwwroot/lib/"))),
        ("generated", _in(dirs, GENERATED_DIRS) | named(GENERATED_NAMES) | path.rlike("(^|/)bin/(Debug|Release|x64|x86)/")),
        ("lockfile", name.isin(LOCKFILES)),
        ("minified", named(MINIFIED_NAMES)),
        ("binary", ends(BINARY_EXTENSIONS) | F.contains(head, F.lit("\0"))),
        ("asset", (end == "svg") | ((_in(low, ASSET_DIRS) | F.contains(path, F.lit("wwwroot/lib"))) & ~ends(CODE_EXTENSIONS) & ~setting)),
        ("large", F.coalesce(size > largest, F.lit(False))),
        ("api_contract", named(CONTRACT_NAMES)),
        ("infra", infra),
        ("build_manifest", named(MANIFEST_NAMES)),
        ("test", _in(dirs, TEST_DIRS) | F.contains(path, F.lit("src/test/")) | tested | named(TEST_NAMES)),
        ("docs", ends(DOC_EXTENSIONS) | named(DOC_NAMES)),
        ("config", named(CONFIG_NAMES) | (_in(low, CONFIG_DIRS) & ~ends(CODE_EXTENSIONS))),
        ("source", ends(CODE_EXTENSIONS)),
    )
    kind = F.when(rules[0][1], rules[0][0])
    for what, met in rules[1:]:
        kind = kind.when(met, what)
    kind = kind.otherwise("other")
    language = F.when(mode == MODULE_MODE, "unknown").otherwise(language_of(path))
    status = F.when(kind.isin(*SKIPPED), F.concat(F.lit("skipped:"), kind)).otherwise("pending")
    return F.when(path.isNotNull(), F.struct(kind.alias("class"), language.alias("language"), status.alias("status")))
