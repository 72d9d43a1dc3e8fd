"""Record layouts of the files the jobs read, as Spark DDL.

A layout is looked up by name: ``layout("datasets")``. CSV dumps carry no header, so the order of
fields is the order of columns in the file.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, order and types as the producing systems write them.
LAYOUTS: dict[str, str] = {
    # catalogue dumps
    "processing_eras": """
        processing_era_id INT, processing_version STRING, creation_date INT, create_by STRING,
        description STRING""",
    "acquisition_eras": """
        acquisition_era_id INT, acquisition_era_name STRING, start_date INT, end_date INT,
        creation_date INT, create_by STRING, description STRING""",
    "dataset_access_types": """
        dataset_access_type_id INT, dataset_access_type STRING""",
    "data_tiers": """
        data_tier_id INT, data_tier_name STRING, data_tier_creation_date DOUBLE,
        data_tier_create_by STRING""",
    "datasets": """
        d_dataset_id INT, d_dataset STRING, d_is_dataset_valid INT, d_primary_ds_id INT,
        d_processed_ds_id INT, d_data_tier_id INT, d_dataset_access_type_id INT,
        d_acquisition_era_id INT, d_processing_era_id INT, d_physics_group_id INT,
        d_xtcrosssection DOUBLE, d_prep_id STRING, d_creation_date DOUBLE, d_create_by STRING,
        d_last_modification_date DOUBLE, d_last_modified_by STRING""",
    "blocks": """
        b_block_id INT, b_block_name STRING, b_dataset_id INT, b_open_for_writing INT,
        b_origin_site_name STRING, b_block_size DOUBLE, b_file_count INT, b_creation_date DOUBLE,
        b_create_by STRING, b_last_modification_date DOUBLE, b_last_modified_by STRING""",
    "files": """
        f_file_id INT, f_logical_file_name STRING, f_is_file_valid INT, f_dataset_id INT,
        f_block_id INT, f_file_type_id INT, f_check_sum STRING, f_event_count INT,
        f_file_size DOUBLE, f_branch_hash_id INT, f_adler32 STRING, f_md5 STRING,
        f_auto_cross_section DOUBLE, f_creation_date DOUBLE, f_create_by STRING,
        f_last_modification_date DOUBLE, f_last_modified_by STRING""",
    "mod_configs": """
        mc_ds_output_mod_config_id INT, mc_dataset_id INT, mc_output_mod_config_id INT""",
    "out_configs": """
        oc_output_mod_config_id INT, oc_app_exec_id INT, oc_release_version_id INT,
        oc_parameter_set_hash_id INT, oc_output_module_label STRING, oc_global_tag STRING,
        oc_scenario STRING, oc_creation_date INT, oc_create_by STRING""",
    "rel_versions": """
        r_release_version_id INT, r_release_version STRING""",
    "file_lumis": """
        fl_run_num INT, fl_lumi_section_num STRING, fl_file_id INT""",
    # replica dumps
    "replica_summary": """
        date BIGINT, site STRING, dataset STRING, size BIGINT, replica_date BIGINT""",
    "block_replicas": """
        now_sec DOUBLE, dataset_name STRING, dataset_id INT, dataset_is_open STRING,
        dataset_time_create DOUBLE, dataset_time_update DOUBLE, block_name STRING, block_id INT,
        block_files INT, block_bytes BIGINT, block_is_open STRING, block_time_create DOUBLE,
        block_time_update DOUBLE, node_name STRING, node_id INT, br_is_active STRING,
        br_src_files BIGINT, br_src_bytes BIGINT, br_dest_files BIGINT, br_dest_bytes BIGINT,
        br_node_files BIGINT, br_node_bytes BIGINT, br_xfer_files BIGINT, br_xfer_bytes BIGINT,
        br_is_custodial STRING, br_user_group_id INT, replica_time_create DOUBLE,
        replica_time_updater DOUBLE""",
    "catalog_replicas": """
        dataset_name STRING, evts INT, size DOUBLE, date DOUBLE, dataset_access_type STRING,
        acquisition_era_name STRING, r_release_version STRING, node_name STRING, pbr_size DOUBLE,
        dataset_is_open STRING, max_replica_time DOUBLE""",
    # monitoring records
    "file_access_records": """
        UNIQUE_ID STRING, FILE_LFN STRING, FILE_SIZE STRING, CLIENT_DOMAIN STRING,
        CLIENT_HOST STRING, SERVER_DOMAIN STRING, SERVER_HOST STRING, SITE_NAME STRING,
        READ_BYTES_AT_CLOSE STRING, READ_BYTES STRING, READ_SINGLE_BYTES STRING,
        READ_SINGLE_OPERATIONS STRING, READ_SINGLE_AVERAGE STRING, READ_SINGLE_SIGMA STRING,
        READ_VECTOR_BYTES STRING, READ_VECTOR_OPERATIONS STRING, READ_VECTOR_AVERAGE STRING,
        READ_VECTOR_SIGMA STRING, READ_VECTOR_COUNT_AVERAGE STRING,
        READ_VECTOR_COUNT_SIGMA STRING, USER_DN STRING, APP_INFO STRING, START_TIME STRING,
        END_TIME STRING, START_DATE BIGINT, END_DATE BIGINT, INSERT_DATE BIGINT""",
    "job_records": """
        JobId STRING, FileName STRING, IsParentFile STRING, ProtocolUsed STRING,
        SuccessFlag STRING, FileType STRING, LumiRanges STRING, StrippedFiles STRING,
        BlockId STRING, StrippedBlocks STRING, BlockName STRING, InputCollection STRING,
        Application STRING, ApplicationVersion STRING, Type STRING, GenericType STRING,
        NewGenericType STRING, NewType STRING, SubmissionTool STRING, InputSE STRING,
        TargetCE STRING, SiteName STRING, SchedulerName STRING, JobMonitorId STRING,
        TaskJobId STRING, SchedulerJobIdV2 STRING, TaskId STRING, TaskMonitorId STRING,
        NEventsPerJob STRING, NTaskSteps STRING, JobExecExitCode STRING,
        JobExecExitTimeStamp BIGINT, StartedRunningTimeStamp BIGINT, FinishedTimeStamp BIGINT,
        WrapWC STRING, WrapCPU STRING, ExeCPU STRING, NCores STRING, NEvProc STRING,
        NEvReq STRING, WNHostName STRING, JobType STRING, UserId STRING, GridName STRING""",
    "output_transfers": """
        tm_id STRING, tm_username STRING, tm_taskname STRING, tm_destination STRING,
        tm_destination_lfn STRING, tm_source STRING, tm_source_lfn STRING, tm_filesize DOUBLE,
        tm_publish DOUBLE, tm_jobid INT, tm_job_retry_count INT, tm_type STRING,
        tm_aso_worker STRING, tm_transfer_retry_count INT, tm_transfer_max_retry_count INT,
        tm_publication_retry_count INT, tm_publication_max_retry_count INT, tm_rest_host STRING,
        tm_rest_uri STRING, tm_transfer_state INT, tm_publication_state INT,
        tm_transfer_failure_reason STRING, tm_publication_failure_reason STRING,
        tm_fts_id STRING, tm_fts_instance STRING, tm_last_update DOUBLE, tm_start_time DOUBLE,
        tm_end_time DOUBLE""",
    "user_activity": """
        dn STRING, dataset_name STRING, site_name STRING, app STRING, uid BIGINT, stream STRING,
        timestamp BIGINT, nacc INT, distinct_users INT, site_tier STRING, cpu_time DOUBLE,
        wc_time DOUBLE, primary_name STRING, processing_name STRING, data_tier STRING""",
    "federation_reads": """
        src_experiment_site STRING, user_dn STRING, file_lfn STRING""",
    "disk_pool_reads": """
        file_lfn STRING, user_dn STRING, host STRING""",
}

# The fields the three access logs carry under their ``data`` wrapper.
LOG_LAYOUTS: dict[str, str] = {
    "cmssw": """
        file_lfn STRING, end_time BIGINT, app_info STRING, site_name STRING""",
    "classads": """
        DESIRED_CMSDataset STRING, RecordTime BIGINT, KEvents FLOAT, Site STRING,
        InputData STRING, CMS_SubmissionTool STRING, Status STRING""",
    "xrootd": """
        file_lfn STRING, end_time BIGINT, client_domain STRING, vo STRING""",
}


def layout(name: str) -> T.StructType:
    """Schema of a flat record layout."""
    return T.StructType.fromDDL(LAYOUTS[name])


def log_layout(source: str) -> T.StructType:
    """Schema of an access log record: the source's fields inside a required ``data`` struct."""
    fields = T.StructType.fromDDL(LOG_LAYOUTS[source])
    return T.StructType([T.StructField("data", fields, nullable=False)])
