"""Schemas of reads, variants and their files."""

READ = "qname string, flag int, chrom string, pos bigint, mq int, cigar string, next_chrom string, next_pos bigint, tlen int, seq string, qual string, tags map<string,string>"
SAMPLE = "struct<gt:array<int>,phased:boolean,bd:string>"
VARIANT = f"chrom string, pos bigint, id string, ref string, alts array<string>, qual double, filter array<string>, info map<string,string>, samples map<string,{SAMPLE}>, ordinal bigint"
REGION = "region_idx int, chrom string, start bigint, stop bigint"
AAF = "chrom string, pos bigint, d_err int, mq int, v_list array<int>"
MODEL = "model_class string, description string, min_mq int, bq array<array<array<double>>>, tlen array<double>, mean_rlen double, min_rlen int, max_rlen int, r_cnt bigint"
