"""Vocabularies of skills and roles: a name, and the other spellings it goes by."""

from __future__ import annotations

# Skills, one a line; spellings behind the colon, "=" in front of those that count only as they are written.
SKILLS = """
Python: Python3
Java
JavaScript: JS, ECMAScript
TypeScript: TS
Go: =Go, Golang
Rust: =Rust
C: =C
C++: CPP
C#: CSharp
Scala
Kotlin
Swift: =Swift
Ruby
PHP
Perl
R: =R
Julia: =Julia
Haskell
Elixir
Erlang
Clojure
MATLAB
SQL
Bash: Shell scripting
HTML: HTML5
CSS: CSS3
React: ReactJS, React.js
Angular: AngularJS
Vue: VueJS, Vue.js
Svelte
Next.js: NextJS
Node.js: NodeJS, Node
Express: =Express, Express.js
Django
Flask: =Flask
FastAPI
Spring Boot
Spring: =Spring, Spring Framework
Ruby on Rails: Rails
Laravel
.NET: DotNet, ASP.NET
GraphQL
REST: RESTful
gRPC
PostgreSQL: Postgres
MySQL
SQLite
Oracle Database
SQL Server: MSSQL
MongoDB: Mongo
Redis
Cassandra: Apache Cassandra
DynamoDB
Elasticsearch: Elastic Search
OpenSearch
Neo4j
Snowflake: =Snowflake
BigQuery
Redshift
Databricks
Kafka: Apache Kafka
RabbitMQ
Pulsar: Apache Pulsar
Spark: =Spark, Apache Spark, PySpark
Flink: Apache Flink
Hadoop: Apache Hadoop
Hive: =Hive, Apache Hive
Airflow: Apache Airflow
dbt
Pandas
NumPy
scikit-learn: sklearn
PyTorch: Torch
TensorFlow
Keras
Hugging Face
LangChain
Machine Learning: ML
Deep Learning
Computer Vision
Natural Language Processing: NLP
Reinforcement Learning
Large Language Models: LLM, LLMs
Data Modeling
Data Warehousing
Statistics
Tableau
Power BI
Looker
Excel: =Excel, Microsoft Excel
AWS: Amazon Web Services
Azure: Microsoft Azure
Google Cloud: GCP, Google Cloud Platform
Docker
Kubernetes: K8s
Helm: =Helm
Terraform
Ansible
Pulumi
Jenkins
GitHub Actions
GitLab CI
CI CD: CICD, Continuous Integration
Linux
Prometheus: =Prometheus
Grafana
Datadog: =Datadog
Git: =Git
iOS: =iOS
Android
React Native
Flutter
Unity: =Unity
Figma
Embedded Systems
Distributed Systems
Microservices
System Design
Test Automation
Selenium
Cypress: =Cypress
Playwright: =Playwright
Agile
Scrum
Jira
Salesforce
SAP: =SAP
"""

# Roles in the same form.
ROLES = """
Software Engineer: Software Developer, Software Development Engineer, SWE, SDE, Programmer, Application Developer
Backend Engineer: Backend Developer, Back End Engineer, Back End Developer, Server Engineer
Frontend Engineer: Frontend Developer, Front End Engineer, Front End Developer, UI Engineer
Full Stack Engineer: Full Stack Developer, Fullstack Engineer, Fullstack Developer
Mobile Engineer: Mobile Developer, iOS Engineer, iOS Developer, Android Engineer, Android Developer
Data Engineer: Data Platform Engineer, ETL Developer, Analytics Engineer
Data Scientist: Applied Scientist, Research Scientist
Data Analyst: Business Intelligence Analyst, BI Analyst, Analytics Analyst
Machine Learning Engineer: ML Engineer, MLE, AI Engineer, Artificial Intelligence Engineer
Site Reliability Engineer: SRE, Production Engineer, Reliability Engineer
DevOps Engineer: Platform Engineer, Infrastructure Engineer, Cloud Engineer
Security Engineer: Application Security Engineer, Security Analyst, Penetration Tester
Embedded Engineer: Firmware Engineer, Embedded Software Engineer
QA Engineer: Test Engineer, SDET, Quality Assurance Engineer
Database Administrator: DBA, Database Engineer
Systems Administrator: Sysadmin, System Administrator
Network Engineer: Network Administrator
Solutions Architect: Software Architect, Cloud Architect, Enterprise Architect
Engineering Manager: Software Engineering Manager, Development Manager
Product Manager: PM, Technical Product Manager
Product Designer: UX Designer, UI Designer, UX Researcher
Technical Writer: Documentation Engineer
Support Engineer: Customer Engineer, Technical Support Engineer
Sales Engineer: Solutions Engineer, Presales Engineer
"""

# Lines that restrict who may apply, and those that only seem to. A denial on the line wins.
CLEARANCE = r"(?i)\b(security clearance|ts/sci|top secret|secret clearance|public trust|polygraph|active clearance)\b"
NO_CLEARANCE = r"(?i)\b(no|not|without|never)\b[^.]{0,40}\b(clearance|polygraph)\b|\bclearance\b[^.]{0,30}\b(not (required|needed)|is a plus|preferred)\b"
CITIZEN = r"(?i)\b(u\.?s\.?|united states|american) (citizens?|citizenship|persons?)\b|\bcitizenship (is )?required\b|\bitar\b|\bexport control"
NO_CITIZEN = r"(?i)\b(regardless of|without regard to|no|not)\b[^.]{0,40}\b(citizens?|citizenship|persons?)\b|\bcitizens?(hip)?\b[^.]{0,30}\bnot (required|needed)\b"


def parsed(text: str) -> list[tuple[str, str, bool]]:
    """(entry, spelling, cased) of a vocabulary; an entry is spelled as its own name unless it says how."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, _, more = line.partition(":")
        spellings = [s.strip() for s in more.split(",") if s.strip()]
        if f"={name}" not in spellings:
            out.append((name, name, False))
        out += [(name, s.lstrip("="), s.startswith("=")) for s in spellings]
    return out
