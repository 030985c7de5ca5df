"""ATT&CK technique dimension (public Enterprise matrix: id, name, tactic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Catalogue of known techniques.
TECHNIQUES: list[tuple[str, str, str]] = [
    ("T1078", "Valid Accounts", "initial_access"),
    ("T1078.002", "Valid Accounts: Domain Accounts", "initial_access"),
    ("T1133", "External Remote Services", "initial_access"),
    ("T1566", "Phishing", "initial_access"),
    ("T1566.001", "Phishing: Spearphishing Attachment", "initial_access"),
    ("T1566.002", "Phishing: Spearphishing Link", "initial_access"),
    ("T1190", "Exploit Public-Facing Application", "initial_access"),
    ("T1059", "Command and Scripting Interpreter", "execution"),
    ("T1059.001", "Command and Scripting Interpreter: PowerShell", "execution"),
    ("T1059.003", "Command and Scripting Interpreter: Windows Command Shell", "execution"),
    ("T1059.005", "Command and Scripting Interpreter: Visual Basic", "execution"),
    ("T1204", "User Execution", "execution"),
    ("T1204.002", "User Execution: Malicious File", "execution"),
    ("T1047", "Windows Management Instrumentation", "execution"),
    ("T1569.002", "System Services: Service Execution", "execution"),
    ("T1053.003", "Scheduled Task/Job: Cron", "persistence"),
    ("T1053.005", "Scheduled Task/Job: Scheduled Task", "persistence"),
    ("T1543.002", "Create or Modify System Process: Systemd Service", "persistence"),
    ("T1543.003", "Create or Modify System Process: Windows Service", "persistence"),
    ("T1547.001", "Boot or Logon Autostart Execution: Registry Run Keys", "persistence"),
    ("T1136.001", "Create Account: Local Account", "persistence"),
    ("T1098", "Account Manipulation", "persistence"),
    ("T1098.004", "Account Manipulation: SSH Authorized Keys", "persistence"),
    ("T1546.003", "Event Triggered Execution: WMI Event Subscription", "persistence"),
    ("T1068", "Exploitation for Privilege Escalation", "privilege_escalation"),
    ("T1548.001", "Abuse Elevation Control Mechanism: Setuid and Setgid", "privilege_escalation"),
    ("T1548.002", "Abuse Elevation Control Mechanism: Bypass UAC", "privilege_escalation"),
    ("T1548.003", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", "privilege_escalation"),
    ("T1027", "Obfuscated Files or Information", "defense_evasion"),
    ("T1027.010", "Obfuscated Files or Information: Command Obfuscation", "defense_evasion"),
    ("T1218", "System Binary Proxy Execution", "defense_evasion"),
    ("T1218.005", "System Binary Proxy Execution: Mshta", "defense_evasion"),
    ("T1218.010", "System Binary Proxy Execution: Regsvr32", "defense_evasion"),
    ("T1218.011", "System Binary Proxy Execution: Rundll32", "defense_evasion"),
    ("T1562.001", "Impair Defenses: Disable or Modify Tools", "defense_evasion"),
    ("T1070.001", "Indicator Removal: Clear Windows Event Logs", "defense_evasion"),
    ("T1564.003", "Hide Artifacts: Hidden Window", "defense_evasion"),
    ("T1550.002", "Use Alternate Authentication Material: Pass the Hash", "lateral_movement"),
    ("T1110", "Brute Force", "credential_access"),
    ("T1110.001", "Brute Force: Password Guessing", "credential_access"),
    ("T1110.003", "Brute Force: Password Spraying", "credential_access"),
    ("T1003.001", "OS Credential Dumping: LSASS Memory", "credential_access"),
    ("T1003.002", "OS Credential Dumping: Security Account Manager", "credential_access"),
    ("T1003.003", "OS Credential Dumping: NTDS", "credential_access"),
    ("T1552.001", "Unsecured Credentials: Credentials In Files", "credential_access"),
    ("T1552.004", "Unsecured Credentials: Private Keys", "credential_access"),
    ("T1555.003", "Credentials from Password Stores: Credentials from Web Browsers", "credential_access"),
    ("T1558.003", "Steal or Forge Kerberos Tickets: Kerberoasting", "credential_access"),
    ("T1087", "Account Discovery", "discovery"),
    ("T1087.002", "Account Discovery: Domain Account", "discovery"),
    ("T1082", "System Information Discovery", "discovery"),
    ("T1016", "System Network Configuration Discovery", "discovery"),
    ("T1018", "Remote System Discovery", "discovery"),
    ("T1069.002", "Permission Groups Discovery: Domain Groups", "discovery"),
    ("T1046", "Network Service Discovery", "discovery"),
    ("T1021", "Remote Services", "lateral_movement"),
    ("T1021.001", "Remote Services: Remote Desktop Protocol", "lateral_movement"),
    ("T1021.002", "Remote Services: SMB/Windows Admin Shares", "lateral_movement"),
    ("T1021.006", "Remote Services: Windows Remote Management", "lateral_movement"),
    ("T1570", "Lateral Tool Transfer", "lateral_movement"),
    ("T1560.001", "Archive Collected Data: Archive via Utility", "collection"),
    ("T1074.001", "Data Staged: Local Data Staging", "collection"),
    ("T1005", "Data from Local System", "collection"),
    ("T1039", "Data from Network Shared Drive", "collection"),
    ("T1071", "Application Layer Protocol", "command_and_control"),
    ("T1071.001", "Application Layer Protocol: Web Protocols", "command_and_control"),
    ("T1071.004", "Application Layer Protocol: DNS", "command_and_control"),
    ("T1568", "Dynamic Resolution", "command_and_control"),
    ("T1568.002", "Dynamic Resolution: Domain Generation Algorithms", "command_and_control"),
    ("T1573", "Encrypted Channel", "command_and_control"),
    ("T1571", "Non-Standard Port", "command_and_control"),
    ("T1105", "Ingress Tool Transfer", "command_and_control"),
    ("T1041", "Exfiltration Over C2 Channel", "exfiltration"),
    ("T1048", "Exfiltration Over Alternative Protocol", "exfiltration"),
    ("T1048.003", "Exfiltration Over Alternative Protocol: Unencrypted Non-C2 Protocol", "exfiltration"),
    ("T1567.002", "Exfiltration Over Web Service: Exfiltration to Cloud Storage", "exfiltration"),
    ("T1030", "Data Transfer Size Limits", "exfiltration"),
    ("T1486", "Data Encrypted for Impact", "impact"),
    ("T1490", "Inhibit System Recovery", "impact"),
    ("T1489", "Service Stop", "impact"),
]


def read_techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TECHNIQUES, "technique_id string, name string, tactic string")
