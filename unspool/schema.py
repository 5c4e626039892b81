"""Schemas of the tables. 32-bit unsigned values are BIGINT, 64-bit ones DECIMAL(20,0)."""

RESOURCE = "struct<type_id:int,type_name:string,name:string,language_id:int,rva:bigint,offset:bigint,size:bigint>"
OBSERVATION = "struct<seq:int,kind:string,offset:bigint,encoding:string,subtype:string,name:string,type_id:int,type_name:string,language_id:int,rva:bigint,size:bigint>"
DECOMPRESSION = "struct<kind:string,reason:string>"
PROFILE = "struct<encoding:string,encryption:string,compression:string>"
RECORD = (
    "struct<record_index:bigint,offset:bigint,subtype:string,subtype_bytes:binary,name:string,name_bytes:binary,compressed:boolean,"
    "compressed_size:bigint,uncompressed_size:bigint,checksum:bigint,checksum_valid:boolean,creation_time:decimal(20,0),last_write_time:decimal(20,0),"
    f"encrypted_data:binary,decrypted_data:binary,decompressed_data:binary,decompression:{DECOMPRESSION},profile:{PROFILE}>"
)
DIAGNOSTIC = "struct<record_index:bigint,offset:bigint,reason:string>"
#: What the parsing kernel gives for each file.
PARSED = f"struct<failure:string,input_kind:string,encoding:string,observations:array<{OBSERVATION}>,records:array<{RECORD}>,diagnostic:{DIAGNOSTIC}>"
TOKEN = "struct<kind:string,text:string,i:bigint,u:decimal(20,0),f:double>"
TOKENS = f"struct<line_count:bigint,tokens:array<{TOKEN}>,error:string>"

#: The eight reasons for which a file or record fails, and what each means.
FAILURES = {
    "NotRecognized": "nothing in the input marks a compiled script",
    "UnsupportedEncoding": "the payload's encoding can't be read",
    "MalformedContainer": "the container's structure is broken",
    "Truncated": "the input ends before the structure does",
    "LimitExceeded": "a size or count passes the configured limit",
    "CryptoMismatch": "decryption gives no valid data",
    "CompressionError": "the compressed data is broken",
    "TokenError": "the token stream can't be decoded",
}
