"""Schemas of the records, as DDL.  Expression trees stay JSON text: inferring them would turn nested trees into strings anyway."""

MESSAGE = "array<struct<role:string,content:string>>"
STATEMENT = "array<struct<speaker:string,expr:string,text:string>>"
PUZZLE = f"id string, people array<string>, statements {STATEMENT}, answer map<string,string>, solution_count int, metadata struct<generator_version:string,dataset_version:string,seed:bigint,max_depth:int,generation_mode:string,balanced_target_pattern:string>"
SFT_EXAMPLE = f"id string, prompt {MESSAGE}, completion {MESSAGE}, messages {MESSAGE}, answer map<string,string>, puzzle string"
RL_EXAMPLE = f"id string, prompt {MESSAGE}, answer map<string,string>, puzzle string"
EVAL_RECORD = "id string, prompt string, prediction string, parsed_answer map<string,string>, parse_reason string, format_valid boolean, ground_truth map<string,string>, correct boolean, ground_truth_pattern string, prediction_pattern string"
GENERATION = "struct<text:string,parsed_answer:map<string,string>,parse_reason:string,format_valid:boolean,parse_success:boolean,reward:double>"
ROLLOUT_GROUP = f"id string, ground_truth map<string,string>, ground_truth_pattern string, generations array<{GENERATION}>"
PROBE_FILE = "probe_seed_meta struct<seed:bigint,indices:array<int>,count:int>, groups array<struct<probe_step:int,prompts:array<struct<id:string,ground_truth_pattern:string,rollouts:array<struct<text:string,reward:double,pattern:string,format_valid:boolean,parse_success:boolean>>>>>>"
TRAIN_METRICS = "step int, loss double, grad_norm double, kl double, entropy double, reward_mean double, mixed_group_ratio double, all_wrong_ratio double, all_correct_ratio double, zero_variance_group_ratio double, avg_correct_per_group double, avg_unique_answers double, reward_mode string, shaped_reward_mean double, exact_reward_mean double, n_exact_all_wrong_groups int, n_rescued_groups int, peak_memory_allocated_gb double"
LANDSCAPE = "id string, gold_pattern string, models map<string,struct<scores:array<double>,q:array<double>,gold_q:double,gold_rank:int>>"
WIDE_ARRAYS = "ids array<string>, gold array<string>, gold_q array<double>"
