"""Column builders. Everything here stays inside the JVM."""

from spoor.functions.entities import (  # noqa: F401
    detection_verdict,
    extract_indicators,
    hash_kind,
    infer_type,
    lookup_path,
    mitre_ids,
    normalize_type,
    url_id,
    valid_mitre,
)
from spoor.functions.paths import (  # noqa: F401
    base_name,
    contains_any,
    expand_env,
    ext_in,
    file_ext,
    glob_any,
    norm_path,
    under_prefix,
)
from spoor.functions.text import (  # noqa: F401
    clip,
    enabled_privs,
    json_from_text,
    key_class,
    magic_mismatch,
    notable_privs,
    safe_int,
    suspicious_imports,
    token_estimate,
)
from spoor.functions.times import (  # noqa: F401
    epoch_iso,
    filetime_ts,
    first_iso,
    iso_z,
    parse_iso,
    unix_us_ts,
    webkit_ts,
)
