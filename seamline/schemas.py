"""Schemas of the records that the engine reads and writes, as DDL."""

from __future__ import annotations

TRACE = (
    "scheduler_name STRING, sample_id STRING, request_index INT, step_index INT, generated_length INT, block_start INT, window_size INT, "
    "default_block_length INT, selected_block_length INT, selected_boundary_index INT, selected_boundary_position INT, selected_score DOUBLE, "
    "threshold DOUBLE, candidate_scores ARRAY<DOUBLE>, candidate_positions ARRAY<INT>, metadata MAP<STRING,STRING>, sample_total_nfe INT, "
    "sample_block_count INT, sample_block_history ARRAY<INT>"
)
PREDICTION = (
    "sample_id STRING, task_name STRING, source_dataset STRING, is_correct BOOLEAN, prediction STRING, gold_solution STRING, oracle_block_sizes ARRAY<INT>, "
    "oracle_block_count INT, block_history ARRAY<INT>, nfe_history ARRAY<INT>, has_final_answer_anchor BOOLEAN, segment_count INT, cache_mode STRING, "
    "cache_policy STRING, prior_correction_applied BOOLEAN, predicted_delta_count INT, boundary_gate_applied BOOLEAN, boundary_carry_mask ARRAY<INT>, "
    "carry_on_boundary_count INT, carry_rate DOUBLE, question STRING, problem STRING, subject STRING, level STRING"
)
SEGMENTED = (
    "source STRING, source_dataset STRING, split STRING, doc_id STRING, row_id INT, id STRING, notebook_path STRING, language STRING, repo STRING, path STRING, "
    "func_name STRING, segmentation_method STRING, boundary_quality STRING, has_docstring BOOLEAN, code_segment_count INT, dataset_version STRING, "
    "lean_split STRING, tags ARRAY<STRING>, proof_style STRING, is_filtered_from_lean BOOLEAN, selection_reason STRING, cell_types ARRAY<STRING>, segments ARRAY<STRING>"
)
LABELLED = (
    "input_ids ARRAY<INT>, boundary_labels ARRAY<INT>, boundary_positions ARRAY<INT>, segments ARRAY<STRING>, phase_labels ARRAY<INT>, "
    "typed_transition_labels ARRAY<INT>, boundary_type_labels ARRAY<INT>, phase_loss_mask ARRAY<INT>, transition_loss_mask ARRAY<INT>, "
    "boundary_loss_mask ARRAY<INT>, boundary_type_loss_mask ARRAY<INT>, source STRING, source_domain STRING, source_view STRING, condition_mask INT, "
    "public_test_token_span ARRAY<INT>, label_confidence STRING, hard_mining_cluster STRING, task_id STRING, serialized_text STRING, code_text STRING, mixture_role STRING"
)
CORRECTION = ("sample_id STRING, boundary_index INT, best_delta INT, gate_label STRING, delta_scores MAP<STRING,DOUBLE>")
SAMPLE = (
    "doc STRUCT<task_id STRING, entry_point STRING, prompt STRING, text STRING, test_list ARRAY<STRING>>, target STRING, filtered_resps ARRAY<ARRAY<STRING>>, "
    "`pass@1` DOUBLE, pass_at_1 DOUBLE, doc_id INT"
)
MANIFEST = (
    "generated_at STRING, subset_label STRING, strategy STRING, sample_size INT, seed INT, total_size INT, indices ARRAY<INT>, task_ids ARRAY<STRING>, "
    "bucket_ranges ARRAY<STRUCT<start:INT,`end`:INT>>"
)
