"""cuegrid.functions"""
