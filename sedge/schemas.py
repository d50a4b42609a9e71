"""Schemas of the relations, as Spark DDL; nothing is inferred from data."""

AXES = "struct<register:string,number_form:string,addressing:string,synonym:string,disfluency:boolean,politeness:boolean,ellipsis:boolean>"
RAW_PAIR = f"id string, template_family string, split string, variant string, transcript string, target string, gold_intent string, audio_path string, snr_db int, axes {AXES}, hard_negative boolean, contrast_group string"
RECORD = (
    "id string, template_family string, split string, variant string, transcript string, target string, gold_intent string, audio_path string, snr_db int, "
    "source_variant string, hard_negative boolean, contrast_group string, perturb_ops array<string>, relabelled_from string, asr_similarity double, roundtrip_identical boolean"
)
#: The columns that every record has; the rest of RECORD is optional.
RECORD_COLUMNS = ["id", "template_family", "split", "variant", "transcript", "target", "gold_intent", "audio_path", "snr_db"]
ROUNDTRIP = (
    "id string, variant string, snr_db int, clean_transcript string, target string, gold_intent string, template_family string, tts_voice string, "
    "tts_length_scale double, noise_key string, peak_attenuation double, mixed_path string, asr_transcript string, asr_ok boolean, asr_error string"
)
REJECT = "id string, reason string, variant string, snr_db int, similarity double, clean string, asr string, was string, duplicate_of string, transcript string, conflicts_with string, collided_on string, target string, other_target string"
FAMILY = "family_id string, intent string, slot_pattern string, description string, split string"
LABEL_PASS = "id string, label string, raw string, at timestamp"
PREDICTION = "id string, transcript string, gold string, raw string, pred string"
SEGMENT = "struct<start_s:double,end_s:double,t0_s:double,forced:boolean,transcript:string,raw:string,canonical:string,dispatched:string,correct:boolean,stt_ms:double,prefill_ms:double,decode_ms:double,validate_ms:double>"
ITEM = f"id string, condition string, reference string, gold string, host string, segments array<{SEGMENT}>"
KEYWORD_EVENT = (
    "struct<intent:string,seq:bigint,frame_index:int,latency_offset_ms:double,latency_onset_ms:double,fsm_ms:double,in_flight:boolean,aborted:boolean,"
    "abort_return_ms:double,server_idle_ms:double,late_b_stale_discarded:boolean>"
)
KEYWORD_TRIAL = (
    "condition string, take string, class string, pass int, kw_offset_s double, kw_onset_s double, "
    f"events array<{KEYWORD_EVENT}>, n_segments_seen int, soc struct<temp:double,throttled:string,freq_khz:string>, frame_ms array<double>, host string"
)
COMMAND = "intent string, shape string, radius double, spacing double, pos array<double>, dir string, dist double, speed double, z double, yaw double, alt double, ids array<int>"
MESSAGE = "seq bigint, branch string, command string, t_publish double"
UTTERANCE = "start bigint, end bigint, t0 bigint, forced boolean"
PIECES_OF_CLIP = "path string, label string, phrase string, base string, split string, seconds double, keyword_offset_s double, source string, voice string, length_scale double, rir string, noise_key string, snr_db int, noise_partition string, gain_db double"

#: The relations that readers.relation() knows by name.
RELATIONS = {
    "raw_pairs": RAW_PAIR, "records": RECORD, "roundtrip": ROUNDTRIP, "rejects": REJECT, "template_families": FAMILY, "label_pass": LABEL_PASS, "predictions": PREDICTION,
    "items": ITEM, "keyword_trials": KEYWORD_TRIAL, "utterances": UTTERANCE, "clips": PIECES_OF_CLIP,
}


def struct(**fields: str):
    """A struct type of simple fields, for functions that are declared before a session exists."""
    from pyspark.sql.types import StructType

    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
