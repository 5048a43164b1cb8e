"""Schemas of the tables that are read and written."""

SPANS = "array<struct<start:int,end:int,type:string>>"
UTTERANCE = f"id string, spoken string, written string, words array<string>, spans {SPANS}, punct array<string>, written_source string, leak_key string, source string"
PAIR = "id string, written string, spoken string, topic string, kind string"
ARTICLE = "article struct<topic:string>, chunks array<struct<text:string,validation_issues:array<string>,all_text_results:array<struct<type:string,text:string>>>>"
CATALOGUE = "entries array<struct<canonical:string,spoken:array<string>>>, models array<struct<canonical:string,spoken:array<string>>>"
BIO_BUNDLE = "id string, split string, tokens array<string>, tokens_json string, bio_tags array<string>, bio_tags_json string, normalized_text string"
TOKEN_BUNDLE = "id string, tokens array<struct<text:string,start:int,end:int>>, bio_tags array<string>, punctuation_targets array<string>, normalized_text string, source_type string"
ANY_BUNDLE = "id string, tokens array<string>, bio_tags array<string>, punctuation_targets array<string>, words array<string>, punct array<string>, spans array<array<string>>, normalized_text string, written string, source_type string, priority_group string, focus_family string"
OLD_CORPUS = "tokens array<string>, itn_tags array<string>, punc_tags array<string>"
PROPOSALS = "index int, spans array<struct<noi:string,viet:string,kieu:string>>"
