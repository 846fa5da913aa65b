"""Schemas of the input shapes."""

HOURS = "struct<open:string,close:string>"
PROPERTIES = (f"struct<slug:string,name:string,description:string,category:string,elevation_m:double,era:string,hours:{HOURS},meshUrl:string,"
              "priceRange:int,amenities:array<string>>")
FEATURE = f"type string, geometry struct<type:string,coordinates:array<double>>, properties {PROPERTIES}"
FEATURES = f"type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:{PROPERTIES}>>"
ROUTE_FEATURES = ("type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<code:string,name:string,"
                  "kind:string,fareBase:double,farePerKm:double,stops:array<struct<name:string,seq:int,coord:array<double>>>>>>")
POLYGON_FEATURES = ("type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<name:string>>>")
HISTORY = ("eras array<struct<key:string,name:string,startYear:int,start_year:int,endYear:int,end_year:int,summary:string>>, "
           "events array<struct<title:string,year:int,era:string,description:string,coord:array<double>>>")
OSM = ("elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,"
       "geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>>>")
SUBMISSION = "id bigint, received timestamp, website string, startedAt string, page string, message string, email string, name string, link string"
REPORT = ("id bigint, created_at timestamp, page_path string, message string, reply_email string, replied_at timestamp, reporter_name string, resolved_at timestamp, "
          "status string, token string, status_note string, checked_at timestamp, attempts int, last_error string, source_link string")
CHANGE = ("id bigint, correction_id bigint, target_table string, slug string, field string, old_value string, new_value string, source_url string, quote string, "
          "applied_at timestamp, undone_at timestamp")
VERDICT = ("id bigint, outcome string, note string, table string, slug string, field string, open string, close string, price_range int, source_url string, quote string")
