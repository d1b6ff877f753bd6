"""Control tables: reading request values, checking them, and the terminal state of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.functions.paths import drop_trailing_slashes, first_unsafe, is_bad_key_path
from sealroute.functions.text import SETUP_MESSAGE_LIMIT, blank_to_null, clean_run_id, is_blank

# Request fields in their declared order.
DECRYPT_FIELDS = ["file_system_name", "source_folder", "destination_folder", "error_folder", "archive_folder"]
DECRYPT_FOLDERS = ["source_folder", "destination_folder", "error_folder", "archive_folder"]
ENCRYPT_FIELDS = [
    "storageAccountName", "container", "tempFolder", "outputFolder", "archiveFolder", "pgpKeyPath", "errorFolder",
]
ENCRYPT_OPTIONAL = ["filePrefix", "runId"]

# The batch cap and the texts a request is answered with.
MAX_FILES = 500
MISSING = "Missing required parameters: "
UNSAFE = "Invalid path (path traversal not allowed): "
NO_KEY_STORE = "Key store not configured."
NO_KEYS = "Failed to retrieve PGP credentials from the key store. Check permissions and secret names."
NO_STORAGE = "Storage connection error."
UNEXPECTED = "Unexpected error occurred. Check the job logs for details."
NO_FILES = "No files found in source folder: "
BAD_JSON = "Invalid JSON body"
ENCRYPT_MISSING = (
    "Missing required parameters: storageAccountName, container, tempFolder, "
    "outputFolder, archiveFolder, pgpKeyPath, errorFolder are all required."
)
BAD_KEY_PATH = "Invalid pgpKeyPath: path traversal not permitted."
SETUP_FAILED = "Could not connect to storage or locate required files: "
NO_FILE = "No staging file found in temp folder."
EMPTY_FILE = "Staging file is empty — no payload to encrypt."
ENCRYPTION_FAILED = "Encryption process failed. Check error log for details."
POST_ENCRYPT_FAILED = (
    "Encryption succeeded but writing output or archiving failed. "
    "Verify if encrypted file already exists before retrying."
)
SUCCESS = "File encrypted and archived successfully."


def parse_body(requests: DataFrame, body: str, fields: list[str], output: str = "body") -> DataFrame:
    """Read raw JSON bodies into a struct of strings; an unreadable body counts as empty."""
    schema = ", ".join(f"`{field}` string" for field in fields)
    return requests.withColumn(output, F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}))


def is_bad_json(body: Column) -> Column:
    """True for a raw body that is absent or no JSON text."""
    return F.try_parse_json(body).isNull()


def param(body_value: Column, query_value: Column) -> Column:
    """The stripped body value, else the stripped query value; blank counts as absent."""
    return F.coalesce(blank_to_null(body_value), blank_to_null(query_value))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of blank fields in the given order, joined by a comma; null when none is missing."""
    names = F.array(*[F.when(is_blank(value), F.lit(name)) for name, value in fields.items()])
    return F.nullif(F.array_join(F.filter(names, lambda name: name.isNotNull()), ", "), F.lit(""))


def any_missing(fields: dict[str, Column]) -> Column:
    missing = F.lit(False)
    for value in fields.values():
        missing = missing | F.coalesce(value == "", F.lit(True))
    return missing


def check_decrypt_requests(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``missing`` and ``unsafe_field``: what is wrong with each decrypt request, or null."""
    folders = DECRYPT_FIELDS if strict else DECRYPT_FOLDERS
    return requests.withColumns({
        "missing": missing_fields({name: F.col(name) for name in DECRYPT_FIELDS}),
        "unsafe_field": first_unsafe({name: F.col(name) for name in folders}, strict),
    })


def check_encrypt_requests(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Clean the folder values and run id of each encrypt request and add its three checks."""
    stripped = {name: drop_trailing_slashes(F.col(name)) for name in ["tempFolder", "outputFolder", "errorFolder"]}
    folders = ["tempFolder", "outputFolder", "archiveFolder", "errorFolder"]
    unsafe = first_unsafe({name: F.col(name) for name in folders}, strict=True) if strict else F.lit(None).cast("string")
    return (
        requests.withColumns(stripped)
        .withColumns({
            "runId": clean_run_id(F.col("runId")),
            "missing": any_missing({name: F.col(name) for name in ENCRYPT_FIELDS}),
            "bad_key_path": F.coalesce(is_bad_key_path(F.col("pgpKeyPath")), F.lit(False)),
            "unsafe_field": unsafe,
        })
    )


def too_many(total: Column, cap: int | None) -> Column:
    return F.lit(False) if cap is None else F.coalesce(total > cap, F.lit(False))


def batch_code(ok: Column, failed: Column) -> Column:
    """200 without failures, 207 with some, 500 when nothing succeeded; skipped files never count."""
    return F.when(failed == 0, 200).when(ok > 0, 207).otherwise(500)


def decrypt_verdict(
    *, missing: Column, key_store_set: Column, unsafe: Column, key_found: Column, storage_error: Column,
    total: Column, ok: Column, failed: Column, unexpected: Column, source_folder: Column, cap: int | None = MAX_FILES,
) -> Column:
    """Struct of ``code`` and ``message`` of a decrypt request; the order of the tests is fixed."""
    def state(code: Column | int, message: Column | str | None) -> Column:
        code = code if isinstance(code, Column) else F.lit(code)
        message = message if isinstance(message, Column) else F.lit(message).cast("string")
        return F.struct(code.cast("int").alias("code"), message.alias("message"))

    return (
        F.when(missing.isNotNull(), state(400, F.concat(F.lit(MISSING), missing)))
        .when(~key_store_set, state(400, NO_KEY_STORE))
        .when(unsafe.isNotNull(), state(400, F.concat(F.lit(UNSAFE), unsafe)))
        .when(~key_found, state(500, NO_KEYS))
        .when(storage_error, state(500, NO_STORAGE))
        .when(unexpected, state(500, UNEXPECTED))
        .when(F.coalesce(total, F.lit(0)) == 0, state(200, F.concat(F.lit(NO_FILES), source_folder)))
        .when(too_many(total, cap), state(400, F.concat(
            F.lit("Too many files in source folder ("), total.cast("string"),
            F.lit(f"). Maximum allowed: {cap}"))))
        .otherwise(state(batch_code(F.coalesce(ok, F.lit(0)), F.coalesce(failed, F.lit(0))), None))
    )


def encrypt_verdict(
    *, bad_json: Column, missing: Column, bad_key_path: Column, unsafe: Column, setup_error: Column,
    picked: Column, empty: Column, encrypt_failed: Column, persist_failed: Column,
) -> Column:
    """Struct of ``code``, ``status`` and ``message`` of an encrypt request, first match wins."""
    def state(code: int, status: str | None, message: Column | str) -> Column:
        message = message if isinstance(message, Column) else F.lit(message)
        return F.struct(F.lit(code).alias("code"), F.lit(status).cast("string").alias("status"),
                        message.alias("message"))

    return (
        F.when(bad_json, state(400, None, BAD_JSON))
        .when(missing, state(400, None, ENCRYPT_MISSING))
        .when(bad_key_path, state(400, None, BAD_KEY_PATH))
        .when(unsafe.isNotNull(), state(400, None, F.concat(F.lit(UNSAFE), unsafe)))
        .when(setup_error.isNotNull(), state(500, "SETUP_FAILED", F.concat(
            F.lit(SETUP_FAILED), F.substring(setup_error, 1, SETUP_MESSAGE_LIMIT))))
        .when(~picked, state(404, "NO_FILE", NO_FILE))
        .when(empty, state(422, "EMPTY_FILE", EMPTY_FILE))
        .when(encrypt_failed, state(500, "ENCRYPTION_FAILED", ENCRYPTION_FAILED))
        .when(persist_failed, state(500, "POST_ENCRYPT_FAILED", POST_ENCRYPT_FAILED))
        .otherwise(state(200, "SUCCESS", SUCCESS))
    )
