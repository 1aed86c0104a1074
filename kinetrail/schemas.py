"""Schemas of the engine's tables, as DDL. Hidden points are null points; undefined features are null."""

from __future__ import annotations

KEY = "video string, track string, frame int"
POSE = f"{KEY}, pts array<struct<x:double,y:double>>, status string, source string"
POINT5 = "video string, frame int, individual string, bodypart string, x double, y double, likelihood double"
COMPONENT = "video string, frame int, comp_id int, parent_id int, area int, cx double, cy double, touches_border boolean, flags array<string>, pts array<struct<x:double,y:double>>, width array<double>, length_px double, n_end int, spur_frac double, width_cv double, area_per_len double"
QC_COLUMNS = "frame int, flags string, n_comp int, n_worms int, area int, length_px double, touches_border boolean, label_status string"
QC = f"video string, {QC_COLUMNS}"
TRACK = "video string, id string, n_frames int, first_frame int, last_frame int, body_length_px double, motion_score double, head_width double, tail_width double, label_status_counts map<string,int>"
SUMMARY = "n_frames int, fps double, width int, height int, n_tracks int, median_length_px double, median_area_px double, p90_area_px double, global_threshold double, clean int, flag_counts map<string,int>, note string, tracks array<struct<id:string,n_frames:int,first_frame:int,last_frame:int,body_length_px:double,motion_score:double,head_width:double,tail_width:double,label_status_counts:map<string,int>>>"
DETECTION = "video string, frame int, det_id long, m array<double>, score float, model string"
EPISODES = "format int, video string, fps double, width int, height int, n_frames int, median_length_px double, median_area_px double, width_px double, n_tracks int, episodes array<struct<id:int,start:int,end:int,frames:int,seconds:double,clip:string,clip_start:int,clip_end:int,needs_manual_prompt:boolean,note:string,tracks:array<struct<track:int,id:string,prompt_frame:int,midline:array<array<double>>,others:array<array<array<double>>>,clean_dist_px:double>>>>"
RESULT = "frame int, track int, obj int, episode int, midline array<double>, area double, plausible boolean"
FRAME_INDEX = "frame int, kind string, episode int"
FRAME = "video string, frame int, ts timestamp, width int, height int, gray binary"
EDGE = "comp_id long, edge_id long, n0 int, n1 int, len double, co array<double>"
